"""Text expressions: keywords of a question, number format, reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# German words that say nothing about a place.
STOPWORDS = [
    "wie", "welche", "welcher", "welches", "sind", "wirklich", "haben", "fahren",
    "lohnt", "vermeiden", "meiden", "zwischen", "morgens", "abends", "mittags",
    "nachts", "puenktlich", "pünktlich", "zuverlaessig", "zuverlässig", "tageszeit",
    "zugtyp", "bahn", "bahnhof", "bahnhoefe", "bahnhöfe", "groessten", "grössten",
    "verspaetung", "verspätung", "verspaetungen", "verspätungen", "wochenende",
    "wochenenden", "werktage", "werktag", "rush", "hour", "zuege", "züge", "zug",
    "der", "die", "das", "und", "oder", "als", "wenn", "denn", "auch", "noch",
]
KEYWORD_PATTERN = "[a-zäöü]{4,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keywords(question: Column | str, stopwords: list[str] = STOPWORDS) -> Column:
    """Words of four or more letters in reading order, without stop-words."""
    words = F.regexp_extract_all(F.lower(_col(question)), F.lit(KEYWORD_PATTERN), F.lit(0))
    skip = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda word: ~F.array_contains(skip, word))


def contains_any(text: Column | str, words: Column) -> Column:
    """True if the lower-cased text holds one of the words; null text holds none."""
    lowered = F.lower(_col(text))
    return F.coalesce(F.exists(words, lambda word: F.contains(lowered, word)), F.lit(False))


def swiss_number(n: Column | str) -> Column:
    """20'444 for 20444."""
    return F.replace(F.format_number(_col(n), 0), F.lit(","), F.lit("'"))


def parsed_reply(reply: Column | str) -> dict[str, Column]:
    """Cause, confidence and reason from a reply that holds one JSON object.

    The object runs from the first opening to the last closing brace. Text without
    a readable object is a parse error; an object without a cause is an error ("fehler").
    """
    body = F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0)
    # Inside brackets, so that anything after the object makes the text unreadable; the
    # parser alone would stop at the end of the first object and be content.
    parsed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    one_object = (body != "") & parsed.isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull()

    def field(name: str, absent: str, unreadable: str) -> Column:
        value = F.try_variant_get(parsed, f"$[0].{name}", "string")
        return F.when(one_object, F.coalesce(value, F.lit(absent))).otherwise(F.lit(unreadable))

    return {
        "llm_ursache": field("primaere_ursache", "fehler", "parse_error"),
        "llm_konfidenz": field("konfidenz", "niedrig", "niedrig"),
        "llm_begruendung": field("begruendung", "", "JSON-Parse-Fehler"),
    }

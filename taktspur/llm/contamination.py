"""Benchmark contamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WINDOW = 13
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> Column:
    """Runs of ASCII letters, digits and all non-ASCII characters, with A-Z lower-cased."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, NO_WORD), "")


def _zipped(df: DataFrame, out: str, left: str, right: str, shift: int, merge) -> DataFrame:
    """``out[i] = merge(left[i], right[i + shift])`` as far as both reach."""
    length = F.least(F.size(left), F.size(right) - shift)
    length = F.greatest(length, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(left, 1, length), F.slice(right, shift + 1, length), merge))


def with_fingerprints(df: DataFrame, length: int, out: str) -> DataFrame:
    """Adds ``out``: for each run of ``length`` words the smallest hash of the grams in it.

    Needs ``h``, the hashes of the words. Grams have five words (or ``length``, if that is less). A
    run's fingerprint depends on its words alone, so equal runs have equal fingerprints wherever
    they stand. Neighbouring runs mostly share theirs, which is what thins the list out.
    """
    gram = min(GRAM, length)
    have, now = 1, "h"
    while have * 2 <= gram:
        df = _zipped(df, f"g{have * 2}", now, now, have, lambda a, b: F.xxhash64(a, b))
        have, now = have * 2, f"g{have * 2}"
    while have < gram:
        df = _zipped(df, f"g{have + 1}", now, "h", have, lambda a, b: F.xxhash64(a, b))
        have, now = have + 1, f"g{have + 1}"
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        df = _zipped(df, f"m{have * 2}", now, now, have, lambda a, b: F.least(a, b))
        have, now = have * 2, f"m{have * 2}"
    if have < width:
        df = _zipped(df, "m", now, now, width - have, lambda a, b: F.least(a, b))
        now = "m"
    return df.withColumn(out, F.col(now)).drop("g2", "g3", "g4", "g5", "m2", "m4", "m8", "m")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _pairs(lengths: list[int], values) -> Column:
    """One array over all lengths: struct(len, v) of each length's values."""
    def part(n: int) -> Column:
        return F.transform(values(n), lambda x: F.struct(F.lit(n).alias("len"), x.alias("v")))

    return F.concat(*map(part, lengths))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted ids as strings).

    Every run of ``window`` words of an item is a window; an item with fewer words, but not none, is
    one window. Texts and items are winnowed: of all grams in a run of that length the smallest hash
    is its fingerprint, so texts that share a window share its fingerprint and none is missed.
    Fingerprints of texts and items meet in an equi-join. Where they meet, the hit is extended to the
    whole run and compared word by word with the items' windows, again by an equi-join. Words in any
    equal run are hit. The work on a text follows its number of words, also where all are hit.

    Null texts have no words. Windows that overlap hit a word once, and items that tie on a window are all
    listed. Null or repeated ids keep their rows; rows equal in id and text get the
    same figures. Items without id are searched for, but not listed. Items with one id are one item.
    An empty benchmark gives no hits, an empty table no rows; other columns are not read.
    """
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(item_text).alias("w"))
             .where(F.size("w") > 0)
             .withColumn("len", F.least(F.size("w"), F.lit(window))))
    # At most ``window`` numbers.
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect()) or [window]

    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    runs = (items.select("item", "w", "len", F.explode(starts).alias("i"))
            .select("item", "len", F.array_join(F.expr("slice(w, i, len)"), " ").alias("run"))
            .groupBy("len", "run").agg(F.array_sort(F.collect_set("item")).alias("items")))
    # Runs of the same items share a set number: a text lists each set once, not each run.
    runs = stored(runs.withColumn("set", F.xxhash64("items")), "runs")

    marked = _hashed(items)
    for n in lengths:
        marked = with_fingerprints(marked, n, f"f{n}")
    chosen = F.filter(_pairs(lengths, lambda n: F.array_distinct(f"f{n}")), lambda p: p["len"] == F.col("len"))
    searched = marked.select(F.explode(chosen).alias("p")).select("p.len", "p.v").distinct()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(id_col, text_col).alias("k"))
    signed = _hashed(texts.select("id", "k", words_of("text").alias("w")))
    signed = signed.withColumn("n_words", F.size("w").cast("long")).drop("w")
    for n in lengths:
        signed = with_fingerprints(signed, n, f"f{n}").withColumn(f"f{n}", F.array_distinct(f"f{n}"))
    signed = stored(signed.drop("h"), "fingerprints")

    met = (signed.select("k", F.explode(_pairs(lengths, lambda n: F.col(f"f{n}"))).alias("p")).select("k", "p.len", "p.v")
           .join(searched, ["len", "v"]).select("k").distinct())
    # Few texts meet a fingerprint; only their words are read again.
    near_words = stored(texts.join(met, "k").select("k", words_of("text").alias("w")), "near")
    near = _hashed(near_words)
    for n in lengths:
        near = with_fingerprints(near, n, f"f{n}")

    def numbered(n: int) -> Column:
        return F.transform(f"f{n}", lambda v, i: F.struct(F.lit(n).alias("len"), (i + 1).alias("i"), v.alias("v")))

    # The places of a text by another equi-join; its words are then read once for all of them.
    places = (near.select("k", F.explode(F.concat(*map(numbered, lengths))).alias("p"))
              .select("k", "p.len", "p.i", "p.v").join(searched, ["len", "v"])
              .groupBy("k").agg(F.collect_set(F.struct("len", "i")).alias("places")))
    worded = near_words.join(places, "k")
    runs_here = F.transform("places", lambda p: F.struct(
        p["len"].alias("len"), p["i"].alias("i"), F.array_join(F.slice("w", p["i"], p["len"]), " ").alias("run")))
    found = stored(
        worded.select("k", F.explode(runs_here).alias("p")).select("k", "p.len", "p.i", "p.run")
        .join(runs.select("len", "run", "set"), ["len", "run"])
        .select("k", "len", "i", "set").distinct(), "found")

    before = Window.partitionBy("k").orderBy("i", "len").rowsBetween(Window.unboundedPreceding, -1)
    hits = (found.select("k", "i", "len").distinct().withColumn("end", F.col("i") + F.col("len"))
            .withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
            .groupBy("k").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("i", "seen"))).alias("n_hit")))
    listed = (found.select("k", "set").distinct()
              .join(runs.select("set", "items").distinct(), "set")
              .select("k", F.explode("items").alias("item"))
              .groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items")))
    figures = hits.join(listed, "k", "left")
    return (signed.select("id", "k", "n_words").join(figures, "k", "left")
            .select(F.col("id").alias(id_col), "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contaminated(found: DataFrame) -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

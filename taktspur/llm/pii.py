"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds beyond the base, each with its score before context; a span counts from ``LEAST_SCORE``.
#: ``card_inner`` and ``phone_inner`` lie in longer runs of digits that fail as a whole.
ADDED_KINDS = {"iban": 0.8, "card_inner": 0.8, "phone_inner": 0.7, "national_id": 0.4,
               "local_phone": 0.3, "access_key": 0.9, "secret": 0.7}
KINDS = (*BASE_KINDS, *ADDED_KINDS)
LEAST_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
CONTEXT_LOSS = 0.3
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": r"e-?mail|mail|contact|correo|courriel",
    "ip": r"ip|address|host|server|adresse",
    "card": r"card|visa|mastercard|credit|amex|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id|passport",
    "local_phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "card_inner": r"card|visa|mastercard|credit|amex|karte|carte|tarjeta",
    "phone_inner": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "access_key": r"key|aws|access",
    "secret": r"login|user|account|credential",
}
#: Words near a span that speak for a plain number.
AGAINST = r"order|invoice|isbn|part no|version|serial"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
CARD_INNER = re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
PHONE_INNER = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
ACCESS_KEY = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")
SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key) ?[=:] ?[^\s,;]{6,}")
SECRET_HINT = re.compile(r"[=:]")
SECRET_VALUE = re.compile(r"[=:] ?")
LEAST_SECRET = 6
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """An account number is right if its rearranged digits leave 1 when divided by 97."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Leftmost matches of local@domain; looks at each @ once, so long runs cost nothing extra."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def addresses(text: str):
    """Four dotted numbers; a longer chain gives one match per four, and each part is at most 255."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in DIGITS.finditer(text):
        if len(m.group()) > 37:  # 19 digits with 18 separators
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str):
    for m in IBAN.finditer(text):
        # The pattern may run on into capitals that follow; the longest valid head counts.
        words, code = m.group().split(" "), m.group()
        for k in range(len(words), 0, -1):
            code = " ".join(words[:k])
            if 15 <= len(code.replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), m.start() + len(code)
                break


def inner_cards(text: str):
    for m in CARD_INNER.finditer(text):
        if luhn(re.sub("[ -]", "", m.group())):
            yield m.span()


class Covered:
    """What spans cover, as sorted stretches that do not overlap."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def within(self, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches that overlap the span, whole."""
        low, high = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return list(zip(self.starts[low:high], self.ends[low:high]))

    def meets(self, start: int, end: int) -> bool:
        low = bisect_right(self.ends, start)
        return low < len(self.starts) and self.starts[low] < end


def free_parts(text: str, start: int, end: int, taken: Covered) -> list[tuple[int, int]]:
    """The parts of a secret that no span of ``taken`` covers and that hold enough of its value."""
    value, at, parts = SECRET_VALUE.search(text, start).end(), start, []
    for s, e in taken.within(start, end):
        parts.append((at, s))
        at = max(at, e)
    return [(a, b) for a, b in [*parts, (at, end)] if b - max(a, value) >= LEAST_SECRET]


def _plain(pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


FINDERS = {
    "email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans,
    "national_id": _plain(NATIONAL), "local_phone": _plain(LOCAL_PHONE),
    "card_inner": inner_cards, "phone_inner": _plain(PHONE_INNER),
    "access_key": _plain(ACCESS_KEY), "secret": _plain(SECRET),
}
CONTEXT_PATTERNS = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in CONTEXT.items()}
AGAINST_PATTERN = re.compile(rf"(?<!\w)(?:{AGAINST})(?!\w)", re.I)


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) in code points, by start and then kind.

    Base spans always count. Spans of the added kinds count from a score of 0.5 and only where no
    base span and no span of an earlier kind lies; of a secret the parts count where none lies.
    """
    names = []
    if "@" in text:
        names.append("email")
    if DIGIT.search(text):
        names += ["ip", "card", "iban", "national_id", "local_phone", "card_inner"]
        if "+" in text:
            names += ["phone", "phone_inner"]
    if "AKIA" in text or "ASIA" in text:
        names.append("access_key")
    if SECRET_HINT.search(text):
        names.append("secret")
    # Spans of one kind never overlap each other, so only what earlier kinds cover is looked at.
    found, taken = [], Covered()
    for kind in KINDS:
        if kind not in names:
            continue
        spans = FINDERS[kind](text)
        if kind == "secret":
            spans = [part for s, e in spans for part in free_parts(text, s, e, taken)]
        for start, end in spans:
            score = 0.9 if kind in BASE_KINDS else ADDED_KINDS[kind]
            near = text[max(0, start - CONTEXT_CHARS):start] + "\n" + text[end:end + CONTEXT_CHARS]
            score += CONTEXT_GAIN * bool(CONTEXT_PATTERNS[kind].search(near))
            score -= CONTEXT_LOSS * bool(AGAINST_PATTERN.search(near))
            score = round(min(1.0, max(0.0, score)), 2)
            if kind not in BASE_KINDS and (
                    score < LEAST_SCORE or taken.meets(start, end)):
                continue
            found.append((start, end, kind, score))
        taken = Covered([s[:2] for s in found])
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def span_column(text: Column) -> Column:
    """array of struct(kind, start, end, score), in order; code points, end exclusive."""
    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint, score: double>>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = [find_spans(t) for t in as_texts(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = [s for r in rows for s in r]
        fields = pa.StructArray.from_arrays([
            pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()),
            pa.array([s[1] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.float64()),
        ], ["kind", "start", "end", "score"])
        return pa.ListArray.from_arrays(pa.array(offsets), fields)
    return spans(text)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, the spans of the whole text.

    A null text is empty and has no span. The work on a very long text follows its length and its spans
    (these times their logarithm). Spans that start together are ordered as their kinds are listed. Null or repeated ids keep their rows; other columns are
    neither read nor returned; an empty table gives an empty table.
    """
    return docs.select(F.col(id_col), span_column(F.col(text_col)).alias("found"))


def mask_personal_data(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; each span in the text becomes its kind in brackets.

    A null text stays null. ``chars_col``, where there is one, is set to the new length of changed texts.
    """
    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact(t, find_spans(t)) for t in texts.to_pylist()],
                        pa.string())
    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.char_length(text_col).cast(kind))
    return out

"""Quality rules: counts of words, symbols, lines and repeats, and a calibrated n-gram classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BASE, as_texts, byte_slices, mix, prefix_hash, span_hash, word_spans
from .linear import (BITS, LinearModel, code_points, collected, constant_model, distinct_ids, feature_counts, fit,
                     labelled_sample, ngram_layers, sigmoid)

SYMBOLS = "#*$%&|<>"
CHAR_SIZES = (1, 2, 3)
WORD_SIZES = (1, 2)
LEAST_WORDS = 50
REPEAT_PERCENT = 50


def features_of(column: pa.Array) -> list[np.ndarray]:
    """Distinct hashed n-grams: 1 to 3 code points and 1 to 2 words, letter case kept."""
    out = []
    for low, high, data, offsets in byte_slices(column):
        codes, at = code_points(as_texts(column.slice(low, high - low)), fold=False)
        starts, ends, first = word_spans(data, offsets)
        words = mix(span_hash(prefix_hash(data), starts, ends))
        chars = list(ngram_layers(mix(codes.astype(np.uint64) + np.uint64(1)), CHAR_SIZES))
        pairs = list(ngram_layers(words, WORD_SIZES, salt=100))
        for i in range(high - low):
            parts = [x[at[i]:max(at[i], at[i + 1] - n + 1)] for n, x in chars]
            parts += [x[first[i]:max(first[i], first[i + 1] - n + 1)] for n, x in pairs]
            out.append(distinct_ids(np.concatenate(parts or [np.zeros(0, np.uint32)])))
    return out


def feature_column(text: str) -> Column:
    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        rows = features_of(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
    return numbers(F.col(text))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by damped Newton steps.

    Targets are pulled off 0 and 1 by the class sizes, so that a perfect split stays finite.
    """
    positives, negatives = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    a, b = 1.0, 0.0
    design = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        slope = design.T @ (p - target)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000,
                least_rows: int = 5, l2: float = 1e-5, steps: int = 200) -> LinearModel:
    """Fit on at most ``per_class`` labelled documents of each class, a fifth of them (by a hash of the id)
    kept for calibration.

    The margins of the kept fifth calibrate the scores (a logistic curve), then the class shares of
    all labels are put in. Labels of one class only, or none, give a constant.
    """
    sample, positives, negatives = labelled_sample(docs, labels, label, feature_column, per_class)
    kept = F.crc32(F.concat(F.lit("kept "), F.col("id").cast("string")).cast("binary")) % 5 == 0
    sizes = {(r["kept"], r["y"]): r["n"]
             for r in sample.groupBy(kept.alias("kept"), "y").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) < 10 or len(sizes) < 4:
        return constant_model(positives, negatives)
    there, absent = feature_counts(sample.where(~kept), least_rows)
    used = there + absent >= least_rows
    learn, own = collected(sample.where(~kept), used)
    model = fit(learn, own, np.ones(1 << BITS), used, 0.5, l2, steps)
    held, y = collected(sample.where(kept), used)
    slope, offset = platt(model.margins(held), y)
    slope = max(slope, 1e-3)
    model.slope *= slope
    model.intercept = slope * model.intercept + offset
    model.intercept += float(np.log(positives / negatives)
                             - np.log((sizes[True, 1] + sizes[False, 1]) / (sizes[True, 0] + sizes[False, 0])))
    return model


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[offsets])


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key was seen before in the same text; it occurs twice or more there."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later, many = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same[:-1]
    many[order] = same[:-1] | same[1:]
    return later, many


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    parts: dict[str, list[np.ndarray]] = {}
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for _, _, data, offsets in byte_slices(column):
        texts = np.arange(len(offsets) - 1)
        starts, ends, first = word_spans(data, offsets)
        sums = prefix_hash(data)
        owner = np.repeat(texts, np.diff(first))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        lengths = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])

        # Lines: cut at every line feed and at the ends of texts.
        feeds = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
        line_end = np.sort(np.concatenate([offsets[1:], feeds]))
        has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_owner = np.searchsorted(offsets, line_start, "right") - 1
        earlier, _ = _repeated(span_hash(sums, line_start, line_end), line_owner)

        words = mix(span_hash(sums, starts, ends))
        covered = np.zeros(len(words), bool)
        if len(words) > 2:
            windows = mix((words[:-2] * BASE + words[1:-1]) * BASE + words[2:])
            whole = owner[:-2] == owner[2:]
            at = np.flatnonzero(whole)
            _, many = _repeated(windows[at], owner[at])
            for k in range(3):
                covered[at[many] + k] = True
        for name, values in (("n_words", np.diff(first)), ("word_chars", np.diff(lengths[first])),
                             ("n_symbols", _per_text(symbol[data], offsets)),
                             ("n_dup_lines", np.bincount(line_owner[earlier], minlength=len(texts))),
                             ("n_repeat_words", _per_text(covered, first))):
            parts.setdefault(name, []).append(values.astype(np.int64))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {n: np.concatenate(parts[n]) if n in parts else np.zeros(0, np.int64) for n in names}


def rate_quality(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.3) -> DataFrame:
    """One row per input row: counts, base_failed, the calibrated score and the verdict ``kept``.

    Words are runs without blanks or \\x09 to \\x0D. ``base_failed``: under 50 words, or more than
    half the words lie in three-word windows that occur twice or more in the text. ``kept``: not
    failed and a score (probability of good quality) of at least ``threshold``.

    A null or empty text has no words and fails. A very long text is counted whole, in memory for itself
    alone; a score equal to the threshold is kept. Null or repeated ids keep their rows. Other columns
    are neither read nor returned. An empty table gives an empty table.
    """
    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                 "n_repeat_words long, score double")
    def rate(texts: pa.Array) -> pa.Array:
        counts = text_counts(texts)
        score = model.probabilities(features_of(texts))
        return pa.StructArray.from_arrays([pa.array(v) for v in counts.values()] + [pa.array(score)],
                                          [*counts, "score"])

    failed = ((F.col("n_words") < LEAST_WORDS)
              | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    return (docs.select(F.col(id_col), rate(F.col(text_col)).alias("r")).select(id_col, "r.*")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))

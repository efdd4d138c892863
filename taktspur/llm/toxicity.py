"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_texts
from .linear import (LinearModel, code_points, collected, constant_model, feature_counts, fit, hashed_ngrams,
                     labelled_sample)

SIZES = (4, 5, 6)
GROUP = 64


def features_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct character n-grams of 4 to 6 lower-cased code points, hashed to 2**20 numbers."""
    out = []
    for k in range(0, len(texts), GROUP):
        out += hashed_ngrams(*code_points(texts[k:k + GROUP]), SIZES)
    return out


def feature_column(text: str) -> Column:
    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        rows = features_of(as_texts(texts))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
    return numbers(F.col(text))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000,
                 usable=None, smoothing: float = 2.0, least_ratio: float = 2.0,
                 least_rows: int = 5, l2: float = 1e-7, steps: int = 300) -> LinearModel:
    """Fit on at most ``per_class`` labelled documents of each class (see ``labelled_sample``).

    Each n-gram's 0/1 feature is scaled by log((p + a) / (n + a)), the smoothed log ratio of its
    document frequencies in the two classes; n-grams in fewer than ``least_rows`` sampled documents
    or with a ratio nearer to 1 than exp(``least_ratio``) are left out. The intercept is moved to
    the class shares of all usable labels. Labels of one class only, or none, give a constant.
    """
    sample, positives, negatives = labelled_sample(docs, labels, label, feature_column, per_class, usable)
    sizes = {r["y"]: float(r["n"]) for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return constant_model(positives, negatives)
    n_there, n_absent = sizes[1], sizes[0]
    there, absent = feature_counts(sample, least_rows)
    ratio = np.log((there + smoothing) / (n_there + 2 * smoothing)
                   * (n_absent + 2 * smoothing) / (absent + smoothing))
    used = (there + absent >= least_rows) & (np.abs(ratio) >= least_ratio)
    rows, y = collected(sample, used)
    model = fit(rows, y, ratio, used, 0.25, l2, steps)
    model.intercept += float(np.log(positives / negatives) - np.log(n_there / n_absent))
    return model


def toxicity_score(model: LinearModel, text: Column) -> Column:
    """Probability of the label 1; the whole text counts, a null text is an empty one."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.probabilities(features_of(as_texts(texts))), pa.float64())
    return score(text)


def score_toxicity(docs: DataFrame, model: LinearModel, id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row (also for null or repeated ids): id, score, predicted.

    Nulls: a null text is scored as the empty text, which has no feature and gets the intercept. A very
    long text is scored whole; a score of exactly 0.5 is predicted 1.
    Other columns are neither read nor returned, so their names cannot clash. An empty table gives
    an empty table.
    """
    return (docs.select(F.col(id_col), toxicity_score(model, F.col(text_col)).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_clean(docs: DataFrame, model: LinearModel, text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns unchanged."""
    return docs.where(toxicity_score(model, F.col(text_col)) < threshold)

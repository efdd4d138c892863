"""Hashed n-gram features and logistic regression, fitted on a bounded labelled sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, mix, stored

BITS = 20


def code_points(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after one another (lower case if ``fold``), and where each starts."""
    low = [t.lower() for t in texts] if fold else texts
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)]).astype(np.int64)
    joined = "".join(low).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), offsets


def distinct_ids(ids: np.ndarray) -> np.ndarray:
    ids = np.sort(ids)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new].astype(np.int32)


def ngram_layers(values: np.ndarray, sizes, bits: int = BITS, salt: int = 0):
    """(n, hashed feature number of the n symbols from each position) for each wanted n."""
    shift, rolling = np.uint64(64 - bits), values
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(rolling) < 2:
                return
            rolling = rolling[:-1] * BASE + values[n - 1:]
        if n in sizes:
            own = rolling ^ np.uint64((0x5DEECE66D * (n + salt)) & (2**64 - 1))
            yield n, ((own * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.uint32)


def hashed_ngrams(codes: np.ndarray, offsets: np.ndarray, sizes) -> list[np.ndarray]:
    """For each text the distinct hashed n-grams (sorted feature numbers) of its symbols."""
    layers = list(ngram_layers(mix(codes.astype(np.uint64) + np.uint64(1)), sizes))
    return [distinct_ids(np.concatenate([x[a:max(a, b - n + 1)] for n, x in layers]
                                        or [np.zeros(0, np.uint32)]))
            for a, b in zip(offsets[:-1], offsets[1:])]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class LinearModel:
    """Weights of the features in use (sorted), intercept, and the scaling of a row.

    The margin of a row is ``slope * (sum of its weights / count ** power) + intercept``, where
    count is the number of its features in use.
    """

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    power: float
    slope: float = 1.0

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), float(self.intercept))
        if len(self.features):
            table = np.full(1 << BITS, np.nan, np.float32)
            table[self.features] = self.weights
            for i, ids in enumerate(rows):
                w = table[ids]
                w = w[~np.isnan(w)]
                if len(w):
                    out[i] += self.slope * float(w.sum(dtype=float)) / len(w) ** self.power
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.margins(rows))


def constant_model(positives: int, negatives: int) -> LinearModel:
    """Without rows of both classes every score is the share of positives (0 without any row)."""
    share = positives / max(positives + negatives, 1)
    edge = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return LinearModel(np.zeros(0, np.int64), np.zeros(0, np.float32), edge, 0.5)


def fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, used: np.ndarray, power: float,
        l2: float, steps: int) -> LinearModel:
    """Logistic regression on 0/1 features times ``scale``; accelerated gradient steps.

    ``scale`` and ``used`` have an entry per feature number; features outside ``used`` have no weight.
    """
    active = np.flatnonzero(used)
    number = np.full(len(used), -1, np.int32)
    number[active] = np.arange(len(active))
    cut = [number[x] for x in rows]
    cut = [x[x >= 0] for x in cut]
    count = np.array([len(x) for x in cut], np.int64)
    at = np.concatenate(cut) if cut else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(cut)), count)
    part = np.maximum(count, 1.0) ** -power
    s, n = scale[active], max(len(y), 1)
    value = s[at] * part[row]
    curve = 0.25 * (float(np.bincount(row, value * value, n).max(initial=0)) + 1) + l2
    w, b = np.zeros(len(active)), 0.0
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(steps):
        error = sigmoid(np.bincount(row, w_ahead[at] * value, n) + b_ahead) - y
        slope = np.bincount(at, error[row] * value, len(active)) / n + l2 * w_ahead
        w_new, b_new = w_ahead - slope / curve, b_ahead - error.sum() / n / curve
        t_new = 0.5 * (1 + np.sqrt(1 + 4 * t * t))
        w_ahead = w_new + (t - 1) / t_new * (w_new - w)
        b_ahead = b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return LinearModel(active, (w * s).astype(np.float32), float(b), power)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, features, per_class: int,
                    usable=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(rows of id, y, x, number of positives and of negatives among all usable labels).

    Takes at most ``per_class`` labelled ids of each class, those with the smallest hash of the id,
    so the broadcast holds 2 * per_class ids whatever the corpus. Labels without a value or id are left
    out; of several labels of one id the largest counts. ``features`` is the column function that turns
    a text into feature numbers on the executors; the rows with them are stored.
    """
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
              .where("id is not null and y in (0, 1)"))
    if usable is not None:
        marked = marked.where(usable("id"))
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (1, 0):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id")
            .select("id", "y", features("text").alias("x")))
    return stored(rows, "labelled"), counts.get(1, 0), counts.get(0, 0)


def feature_counts(rows: DataFrame, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class 1 and of class 0 that have each feature number; 0 where fewer than ``least_rows`` have it."""
    counted = (rows.select("y", F.explode("x").alias("f")).groupBy("f")
               .agg(F.sum("y").cast("int").alias("there"), F.sum(1 - F.col("y")).cast("int").alias("absent"))
               .where(F.col("there") + F.col("absent") >= least_rows).toArrow())
    there, absent = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    at = counted["f"].to_numpy()
    there[at], absent[at] = counted["there"].to_numpy(), counted["absent"].to_numpy()
    return there, absent


def collected(rows: DataFrame, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(the used features of each row, 0/1 labels) in the order of the ids; no other feature travels."""
    bits = np.packbits(used)

    @F.arrow_udf("array<int>")
    def kept(x: pa.Array) -> pa.Array:
        wanted, offsets = np.unpackbits(bits).astype(bool), x.offsets.to_numpy()
        flat = x.values.to_numpy(zero_copy_only=False)
        hit = wanted[flat]
        sums = np.concatenate([[0], np.cumsum(hit)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sums[offsets]), pa.array(flat[hit], pa.int32()))

    found = rows.select("id", "y", kept("x").alias("x")).toArrow()
    # The same rows in the same order whatever the partitioning.
    order = np.lexsort((np.array(found["y"].to_pylist(), np.int64), np.array(found["id"].to_pylist())))
    x = found["x"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    offsets, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
    y = np.array(found["y"].to_pylist(), float)
    return [flat[offsets[i]:offsets[i + 1]] for i in order], y[order]

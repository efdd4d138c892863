"""Language model scores: all segmentations of every word, weighted by unigram piece scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from .common import (as_texts, ascii_lower, byte_slices, mix, once, prefix_hash, span_hash,
                     stored, word_spans)

MARK = "▁"
#: Words whose figures are sent to every task; the others are joined.
HEAD_WORDS = 1 << 18
FLUSH_WORDS = 1 << 21
TEN = float(np.log(10))


class PieceScores:
    """Natural-log probabilities of the pieces of an existing vocabulary, and the lattice over a word."""

    def __init__(self, path: str, counts: np.ndarray, ends: int):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = np.array([not (model.is_control(i) or model.is_unknown(i)) for i in range(size)])
        weights = (counts + 0.5) * usable
        total = float(weights.sum() + ends + 0.5)
        self.end = math.log((ends + 0.5) / total)
        self.score, self.byte = {}, [0.0] * 256
        for i in np.flatnonzero(usable):
            value = math.log(weights[i] / total)
            piece = model.id_to_piece(int(i))
            if model.is_byte(int(i)):
                self.byte[int(piece[3:5], 16)] = value
            else:
                self.score[piece] = value
        self.longest = max(map(len, self.score), default=1)

    def word(self, word: str) -> float:
        """log of the summed probability of all segmentations of the marked word.

        Forward recursion: before[j] is the log probability of all ways to write the first j
        symbols. A symbol that is no piece itself can be written as its UTF-8 bytes.
        """
        log, exp = math.log, math.exp
        text = MARK + word
        get, longest, byte = self.score.get, self.longest, self.byte
        before = [0.0]
        for j in range(1, len(text) + 1):
            terms = []
            for i in range(max(0, j - longest), j):
                piece = get(text[i:j])
                if piece is not None:
                    terms.append(before[i] + piece)
            if text[j - 1] not in self.score:
                spelled = text[j - 1].encode("utf-8", "surrogatepass")
                terms.append(before[j - 1] + sum([byte[b] for b in spelled]))
            if len(terms) == 1:
                before.append(terms[0])
            else:
                # Single numbers: the functions for whole arrays take twice the time here.
                top = max(terms)
                before.append(top + log(sum([exp(t - top) for t in terms])))
        return before[-1]


def sliced_words(column: pa.Array):
    """Per slice: (first row, last row, lower-cased bytes, starts, ends, first word of each row, word hashes)."""
    for low, high, data, offsets in byte_slices(column):
        data = ascii_lower(data)
        starts, ends, first = word_spans(data, offsets)
        hashes = mix(span_hash(prefix_hash(data), starts, ends)).view(np.int64)
        yield low, high, data, starts, ends, first, hashes


def count_words(docs: DataFrame, text_col: str, learned: Column) -> DataFrame:
    """(h, word, c, n): hash and bytes of each distinct word, its count in learned texts and in all.

    Each task sums up about two million words before it sends a row for each distinct one.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def flush():
            h, word, c, n = (np.concatenate(x) for x in zip(*parts))
            keys, at, group = np.unique(h, return_index=True, return_inverse=True)
            sums = [np.bincount(group, x, len(keys)).astype(np.int64) for x in (c, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(word[at].tolist(), pa.binary()), *map(pa.array, sums)],
                ["h", "word", "c", "n"])

        for batch in batches:
            known = np.asarray(batch.column(1).to_pylist(), bool)
            for low, high, data, starts, ends, first, hashes in sliced_words(batch.column(0)):
                if not len(hashes):
                    continue
                row_known = np.repeat(known[low:high], np.diff(first))
                keys, at, group = np.unique(hashes, return_index=True, return_inverse=True)
                raw = data.tobytes()
                word = np.empty(len(keys), object)
                word[:] = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                parts.append((keys, word, np.bincount(group, row_known, len(keys)),
                              np.bincount(group, minlength=len(keys))))
                waiting += len(keys)
                if waiting > FLUSH_WORDS // 4:
                    yield flush()
                    parts, waiting = [], 0
        if parts:
            yield flush()

    return (docs.select(F.col(text_col).alias("text"), learned.alias("learned"))
            .mapInArrow(count, "h long, word binary, c long, n long")
            .groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n")))


def piece_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each piece of the vocabulary is used for the learned words: one row a piece at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("pieces only", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))
        totals = np.zeros(model.get_piece_size())
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            ids = model.encode(texts, num_threads=1)
            weight = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            flat = np.array([i for x in ids for i in x], np.int64)
            totals += np.bincount(flat, weight, len(totals))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used].astype(np.int64))], ["id", "n"])

    rows = (words.where("c > 0").select("word", "c").mapInArrow(count, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    size = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    out = np.zeros(size)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def head_of(scored: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, all with a larger ``n`` than the others: no task has to sort them.

    Words are counted by eighths of a doubling of n, of which there are a few hundred at any size. As many of
    the upper ones are taken as fit.
    """
    step = F.floor(F.log2("n") * 8)
    taken, room = None, most
    for at, rows in sorted(scored.groupBy(step.alias("at")).count().collect(), reverse=True):
        if rows > room:
            break
        taken, room = at, room - rows
    return scored.limit(0) if taken is None else scored.where(step >= taken)


def lattice_scores(docs: DataFrame, learned: Column, model: str = "piece_bpe_32k.model",
                   id_col: str = "doc_id", text_col: str = "text",
                   head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased, parted by blanks and \\x09 to \\x0D) and one end. The
    vocabulary is an existing one; as that of a BPE model has ranks for scores, its unigram scores are
    the relative frequencies of its pieces in the learned words. ``score`` is the log10 probability
    of the text: each word's is summed over all its segmentations into pieces by a forward recursion,
    and the end has one of its own. ``base_score`` is the add-one unigram word score.

    Words are counted once over all texts and every distinct word runs through the lattice once. The
    figures of the most frequent words, ``head_words`` at most, travel to the tasks as sorted arrays of
    bounded size; rarer words are joined by their 64-bit hash, so nothing depends on the size of the
    vocabulary.

    A null text has the end alone; a very long one is read word by word, and equal words score alike; null or repeated ids keep their rows; other columns are neither
    read nor returned; an empty table gives an empty table. Without learned texts every count is 0 and
    pieces are equally likely.
    """
    path = public_tokenizers.path(model)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learned.alias("learned"))
    words = stored(count_words(texts, "text", F.col("learned")), "words")
    ends = texts.where("learned").count()
    total, known = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, vocabulary = int(total) + ends, int(known) + (ends > 0)
    counts = piece_counts(words, path)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = PieceScores(path, counts, ends)
        for batch in batches:
            marginal = [scores.word(w.decode("utf-8", "replace")) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(marginal, pa.float64())],
                ["h", "c", "n", "p"])

    scored = stored(words.select("h", "word", "c", "n").repartition("h")
                    .mapInArrow(score_words, "h long, c long, n long, p double"), "scores")
    head = head_of(scored, head_words).select("h", "c", "p").toArrow()
    order = np.argsort(head["h"].to_numpy())
    head_h = head["h"].to_numpy()[order]
    head_c = head["c"].to_numpy()[order]
    head_p = head["p"].to_numpy()[order].astype(np.float64)
    end_p = PieceScores(path, counts, ends).end

    @F.arrow_udf("n_words long, known long, base double, p double, rare array<struct<h: bigint, k: bigint>>")
    def read(column: pa.Array) -> pa.Array:
        out: list[list] = [[], [], [], []]
        rare_h, rare_k, rare_n = [], [], []
        logs = np.log10(head_c + 1.0)
        for low, high, _, _, _, first, hashes in sliced_words(column):
            at = np.minimum(np.searchsorted(head_h, hashes), max(len(head_h) - 1, 0))
            found = head_h[at] == hashes if len(head_h) else np.zeros(len(hashes), bool)
            at = at[found]
            owner = np.repeat(np.arange(high - low), np.diff(first))
            mine, size = owner[found], high - low
            out[0].append(np.diff(first))
            out[1].append(np.bincount(mine, head_c[at] > 0, size).astype(np.int64))
            out[2].append(np.bincount(mine, logs[at], size))
            out[3].append(np.bincount(mine, head_p[at], size))
            h, o = hashes[~found], owner[~found]
            sort = np.lexsort((h, o))
            h, o = h[sort], o[sort]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            edges = np.flatnonzero(new)
            rare_h.append(h[edges])
            rare_k.append(np.diff(np.append(edges, len(h))))
            rare_n.append(np.bincount(o[edges], minlength=size))

        def joined(parts, kind):
            return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        offsets = np.concatenate([[0], np.cumsum(joined(rare_n, np.int64))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array(joined(rare_h, np.int64)), pa.array(joined(rare_k, np.int64))], ["h", "k"])
        return pa.StructArray.from_arrays(
            [pa.array(joined(out[0], np.int64)), pa.array(joined(out[1], np.int64)),
             pa.array(joined(out[2], np.float64)), pa.array(joined(out[3], np.float64)),
             pa.ListArray.from_arrays(pa.array(offsets), pairs)],
            ["n_words", "known", "base", "p", "rare"])

    # Stored, so that a row keeps its number between the two uses.
    rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), "id",
                               read(F.col("text")).alias("r")).select("row", "id", "r.*"), "rows")
    rare = (rows.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.k")
            .join(scored.select("h", "c", "p"), "h")
            .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"),
                                F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("base2"),
                                F.sum(F.col("k") * F.col("p")).alias("p2")))
    level = float(np.log10(train_tokens + vocabulary + 1))
    end_known = 1 if ends else 0
    both = rows.drop("rare").join(rare, "row", "left").fillna(0, ["known2", "base2", "p2"])
    return both.select(
        F.col("id").alias(id_col), (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.col("known2") + end_known).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base2") + float(np.log10(ends + 1)) - (F.col("n_words") + 1) * level)
        .alias("base_score"),
        ((F.col("p") + F.col("p2") + end_p) / TEN).alias("score"))

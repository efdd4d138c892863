"""Ranked lexical search: short lists summed up first, long lists skipped document by document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import ascii_lower, byte_slices, mix, once, prefix_hash, span_hash, stored

#: Text of the items that are searched for in one pass, and their number.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 1 << 14
#: Postings and documents of one inverted block in a task.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 16
#: Documents whose long lists are looked at together, between two looks at the threshold.
STRIDE = 1024
#: Short lists of an item hold this share of the block's documents together.
SHORT_SHARE = 8
#: Parts into which the candidates of an item are dealt before the last ranking.
SHARES = 64


def term_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all terms (ASCII letters and digits, all non-ASCII), and each text's first term."""
    inside = once("term bytes", lambda: np.array(
        [b >= 128 or chr(b).isalnum() for b in range(256)]))[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])[:len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])[:len(data)])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def term_hashes(column: pa.Array):
    """Per slice: number of rows, first term of each row, hash and length of each term."""
    for low, high, data, offsets in byte_slices(column):
        data = ascii_lower(data)
        starts, ends, first = term_spans(data, offsets)
        yield high - low, first, mix(span_hash(prefix_hash(data), starts, ends)), ends - starts


class Items:
    """A block of items: the distinct terms of all, and each item's terms with their repeats."""

    def __init__(self, texts: list[str]):
        hashes, lengths, counts = [], [], []
        for _, first, h, n in term_hashes(pa.array(texts, pa.large_string())):
            hashes.append(h), lengths.append(n), counts.append(np.diff(first))
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.hash, at, number = np.unique(flat, return_index=True, return_inverse=True)
        self.length = np.concatenate([np.zeros(0, np.int64), *lengths])[at]
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
        self.terms = [np.unique(number[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:])]

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are terms of the items, and their numbers."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        found = np.flatnonzero((self.hash[at] == hashes) & (self.length[at] == lengths))
        return found, at[found]


def _postings(items: Items):
    """Texts to (id, n, terms, tfs): the number of all terms, and the items' terms with their counts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = len(items.hash)
        for batch in batches:
            sizes, terms, tfs, held = [], [], [], []
            for rows, first, hashes, lengths in term_hashes(batch.column(1)):
                found, number = items.find(hashes, lengths)
                owner = np.repeat(np.arange(rows), np.diff(first))[found]
                keys, count = np.unique(owner * vocabulary + number, return_counts=True)
                sizes.append(np.diff(first))
                terms.append(keys % max(vocabulary, 1))
                tfs.append(count)
                held.append(np.bincount(keys // max(vocabulary, 1), minlength=rows))
            if not sizes:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(held))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32)))
                     for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), *lists],
                ["id", "n", "terms", "tfs"])
    return read


class Block:
    """Inverted lists over some documents, numbered by ascending id, with what each posting adds to a score."""

    def __init__(self, ids: pa.Array, m: np.ndarray, held: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weight: np.ndarray):
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        self.ids = ids.take(pa.array(order))
        self.docs = docs = len(order)
        number = np.empty(docs, np.int64)
        number[order] = np.arange(docs)
        doc = np.repeat(number, held)
        adds = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, held)))
        keys = terms * docs + doc
        by_list = np.argsort(keys)
        keys = keys[by_list]
        self.doc, self.adds = doc[by_list], adds[by_list]
        # Where each list enters each stride of documents, and the most it adds there.
        self.strides = -(-docs // STRIDE)
        edges = np.minimum(np.arange(self.strides + 1) * STRIDE, docs)
        self.present, self.row = np.unique(terms), {}
        self.row = np.full(len(weight), -1)
        self.row[self.present] = np.arange(len(self.present))
        self.enter = np.searchsorted(keys, self.present[:, None] * docs + edges)
        self.most = np.zeros((len(self.present), self.strides), np.int64)
        begin, end = self.enter[:, :-1].ravel(), self.enter[:, 1:].ravel()
        filled = np.flatnonzero(end > begin)
        if len(filled):
            self.most.ravel()[filled] = np.maximum.reduceat(self.adds, begin[filled])

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int):
        """Numbers and scores of the k best documents with a score of ``least`` or more."""
        rows = self.row[terms]
        repeats = repeats[rows >= 0]
        rows = rows[rows >= 0]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.enter[rows, -1] - self.enter[rows, 0]
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(np.cumsum(size[order]), self.docs // SHORT_SHARE, "right"))
        lists = [_Summed(self, rows[order[:short]], repeats[order[:short]])] if short else []
        lists += [_Long(self, r, q) for r, q in zip(rows[order[short:]], repeats[order[short:]])]
        most = np.stack([x.most for x in lists])

        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        room = most.sum(axis=0)
        for s in np.flatnonzero(room >= least):
            if room[s] < least:
                continue
            rising = np.argsort(most[:, s], kind="stable")
            reach = np.cumsum(most[rising, s])
            # Lists that together cannot lift a document to the threshold name no candidates.
            lazy = int(np.searchsorted(reach, least, "left"))
            base = s * STRIDE
            score = np.zeros(min(STRIDE, self.docs - base), np.int64)
            for j in rising[lazy:]:
                doc, adds = lists[j].within(s)
                score[doc - base] += adds
            found = np.flatnonzero(score)
            for place in range(lazy - 1, -1, -1):
                found = found[score[found] + reach[place] >= least]
                if not len(found):
                    break
                doc, adds = lists[rising[place]].within(s)
                if len(doc):
                    at = np.minimum(np.searchsorted(doc, found + base), len(doc) - 1)
                    score[found] += np.where(doc[at] == found + base, adds[at], 0)
            found = found[score[found] >= least]
            if len(found):
                best_docs = np.concatenate([best_docs, found + base])
                best = np.concatenate([best, score[found]])
                if len(best) > k:
                    top = np.lexsort((best_docs, -best))[:k]
                    best_docs, best = best_docs[top], best[top]
                if len(best) == k:
                    least = max(least, int(best.min()))
        return best_docs, best


class _Long:
    """One inverted list, entered at any stride of documents."""

    def __init__(self, block: Block, row: int, repeats: int):
        self.block, self.enter, self.repeats = block, block.enter[row], repeats
        self.most = block.most[row] * repeats

    def within(self, stride: int):
        a, b = self.enter[stride], self.enter[stride + 1]
        return self.block.doc[a:b], self.block.adds[a:b] * self.repeats


class _Summed:
    """The sums of several short lists as one list with bounds of its own."""

    def __init__(self, block: Block, rows: np.ndarray, repeats: np.ndarray):
        spans = [slice(block.enter[r, 0], block.enter[r, -1]) for r in rows]
        doc = np.concatenate([block.doc[s] for s in spans])
        adds = np.concatenate([block.adds[s] * q for s, q in zip(spans, repeats)])
        order = np.argsort(doc, kind="stable")
        doc, adds = doc[order], adds[order]
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        self.doc, self.adds = doc[new], np.add.reduceat(adds, new)
        self.enter = np.searchsorted(self.doc, np.arange(block.strides + 1) * STRIDE)
        self.most = np.zeros(block.strides, np.int64)
        filled = np.flatnonzero(np.diff(self.enter))
        self.most[filled] = np.maximum.reduceat(self.adds, self.enter[filled])

    def within(self, stride: int):
        a, b = self.enter[stride], self.enter[stride + 1]
        return self.doc[a:b], self.adds[a:b]


def _candidates(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Postings to (item, id, score): each block's best documents for every item."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The least score that still counts; it only rises, over all blocks of the task.
        least = np.ones(len(items.terms), np.int64)
        waiting: list[pa.RecordBatch] = []
        postings = docs = 0

        def flush():
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids, n, terms, tfs = (table.column(i).combine_chunks() for i in range(4))
            n = n.to_numpy()
            held = terms.value_lengths().to_numpy()
            block = Block(ids, 75 + (25 * n * n_docs) // n_terms, held,
                          terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), weight)
            item, doc, score = [], [], []
            for i, (numbers, repeats) in enumerate(items.terms):
                d, s = block.search(numbers, repeats, k, int(least[i]))
                if len(s) == k:
                    least[i] = max(least[i], int(s.min()))
                item.append(np.full(len(d), i)), doc.append(d), score.append(s)
            item, doc, score = map(np.concatenate, (item, doc, score))
            return pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), block.ids.take(pa.array(doc)), pa.array(score)],
                ["item", "id", "score"])

        for batch in batches:
            low = 0
            sizes = np.cumsum(batch.column(2).value_lengths().to_numpy())
            while low < batch.num_rows:
                before = sizes[low - 1] if low else 0
                high = int(np.searchsorted(sizes, before + BLOCK_POSTINGS - postings, "right"))
                high = min(max(high, low + 1), low + BLOCK_DOCS - docs, batch.num_rows)
                waiting.append(batch.slice(low, high - low))
                postings, docs, low = postings + int(sizes[high - 1] - before), docs + high - low, high
                if postings >= BLOCK_POSTINGS or docs >= BLOCK_DOCS or low < batch.num_rows:
                    yield flush()
                    waiting, postings, docs = [], 0, 0
        if waiting:
            yield flush()
    return search


def _item_blocks(queries: DataFrame):
    """Blocks of rows whose texts come to ``BLOCK_BYTES`` at most, or one longer item."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        length = len((row["text"] or "").encode())
        if block and (size + length > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append(row)
        size += length
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: (item id, rank, id, score), scores in whole numbers.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A term weighs
    w = floor(1000 ln((2N+2)/(2df+1))), and a document scores the sum over the item's terms, repeats
    included, of w * (10**9 tf div (1000 tf + 12 m)) with m = 75 + (25 n N div L).

    Items come in blocks of bounded text. For each block one pass over the documents writes, per
    document, its number of terms and the counts of those that the block's items use; df, N and L are
    sums over that table. A second pass inverts it by bounded blocks of documents in each task. For an
    item, the short lists are summed up; their sums are one more list with bounds. Then the documents
    are gone through by ascending id, a stride at a time: strides whose bounds fall short of the k-th
    best score are skipped, lists that together fall short name no candidates and are only probed for
    those that can still reach it. Each block of documents sends at most k rows an item, which are
    ranked in shares and then once more. Every document is looked at or ruled out by an exact bound, so
    nothing is missed.

    Null texts have no terms. Each row is a document or an item of its own, also where ids repeat; equal
    scores go to the smaller id, null ids last. Only scores above 0 count, so an item without terms has
    no rows. Very long texts are read whole; a term is told by a 64-bit hash and its length. Empty
    tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in queries.schema.fields}
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for block in _item_blocks(queries.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))):
        items = Items([r["text"] for r in block])
        if not len(items.hash):
            continue
        schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()),
                               *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("terms", "tfs")]])
        index = stored(texts.mapInArrow(_postings(items), schema).where("n > 0"), "postings")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        # One row for each term of this block's items at most.
        df = np.zeros(len(items.hash), np.int64)
        for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

        found = index.mapInArrow(
            _candidates(items, weight, n_docs, n_terms, k),
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type),
                          T.StructField("score", T.LongType())]))
        best = [F.desc("score"), F.asc_nulls_last("id")]
        first = Window.partitionBy("item", "share").orderBy(*best)
        last = Window.partitionBy("item").orderBy(*best)
        ranked = (found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
                  .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank", "share")
                  .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k))
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], T.StructType(
            [T.StructField("item", T.IntegerType()), T.StructField("name", kinds[item_col])]))
        parts.append(ranked.join(names, "item").select(
            F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item_col, kinds[item_col]), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, id_type), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionAll, parts)

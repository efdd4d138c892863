"""Packing: bounded-space best fit per partition, leftovers merged at the end."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import once, stored

WINDOW = 1024
OPEN_WINDOWS = 64
#: Partitions (or groups of leftovers) whose open windows are merged by one task in a round.
MERGED_TOGETHER = 64
#: Code points on which both libraries split alike (tested); other texts go through the slower one.
PLAIN = re.compile("[\x00-ɏͰ-ͷͺ-Ϳ΄-ΊΌΎ-Ρ"
                   "Σ-ӿ‐-⁤₠-₿←-⏿─-➿"
                   "ぁ-ゖ゠-ヿ一-鿯가-힣\U0001f600-\U0001f64f]*")
PIECE = ("doc {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
         "offset long, merged boolean")


class ByteEncoder:
    """Ids as the ``tokenizers`` file gives them, through the same vocabulary as ranks where that is safe.

    Texts with code points on which the two libraries may split differently, or with the file's
    special strings, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str, ranks_path: str):
        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class OpenWindows:
    """At most ``most`` windows being filled; each holds pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, most: int, size: int):
        self.most, self.size, self.windows = most, size, []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Place one document or piece; yields windows that are full."""
        at = 0
        while len(ids) - at >= self.size:
            yield [(doc, start + at, ids[at:at + self.size], total)]
            at += self.size
        while at < len(ids):
            left = len(ids) - at
            fits = [w for w in self.windows if w[0] >= left]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                best = [self.size, []]
                self.windows.append(best)
            else:
                # None fits: the fullest goes out, filled up with the head of this piece.
                best = min(self.windows, key=lambda w: w[0])
            take = min(left, best[0])
            best[1].append((doc, start + at, ids[at:at + take], total))
            best[0] -= take
            at += take
            if not best[0]:
                self.windows = [w for w in self.windows if w is not best]
                yield best[1]


def _rows(windows, first: int, merged: bool, id_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
    columns: list[list] = [[] for _ in range(8)]
    for pieces in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            row = (doc, start, len(ids), np.ascontiguousarray(ids, "<u4").tobytes(), total, first, offset, merged)
            for c, v in zip(columns, row):
                c.append(v)
            offset += len(ids)
        first += 1
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "merged"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names), first


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = 0) -> DataFrame:
    """One row per piece: doc (the id), start, length, ids (little-endian u32), doc_tokens, sequence_id, offset.

    Every document becomes the tokenizer's ids and then ``end_id``. Each partition streams its
    documents through at most ``open_windows`` windows: whole windows are cut off, the rest goes to
    the open window it fits best; where none fits and no more may be opened, the fullest is filled
    with the head of the piece and sent out. So windows leave full, with no padding. What is open at
    the end of a partition (at most ``open_windows`` windows) is merged in the same way by groups of
    64 partitions, and again by groups of groups, until one group is left, whose last windows are
    the only ones shorter than ``window``.

    The pieces are written once to the shared folder, so that texts are encoded once and a lost
    executor does not change sequence numbers; a number is the partition's number and a counter.

    Nulls: a null text is empty and gives the one piece that holds ``end_id``; null or repeated ids
    keep their pieces. A very long text is encoded whole and cut into windows; of windows with equal room
    the first opened takes the piece. Other columns are neither read nor returned; an empty table gives no piece.
    """
    id_type = docs.schema[id_col].dataType
    schema = PIECE.format(id=id_type.simpleString())
    path = public_tokenizers.path(f"{tokenizer}.json")
    ranks = public_tokenizers.path(f"{tokenizer}.tiktoken")

    def encode_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = once(("bytes", path), lambda: ByteEncoder(path, ranks))
        number = TaskContext.get().partitionId() << 36
        open_ones, full, kept, kind = OpenWindows(open_windows, window), [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                for done in open_ones.add(doc, 0, ids, len(ids)):
                    full.append(done)
                    kept += 1
                if len(full) >= 512:
                    out, number = _rows(full, number, True, kind)
                    full = []
                    yield out
        if kind is not None:
            out, number = _rows(full, number, True, kind)
            yield out
            out, number = _rows([w[1] for w in open_ones.windows], number, False, kind)
            yield out

    def merge(batches: Iterator[pa.RecordBatch], last: bool, level: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (level << 60) | (TaskContext.get().partitionId() << 36)
        open_ones, full, kind = OpenWindows(open_windows, window), [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for doc, start, ids, total in zip(*columns):
                full += open_ones.add(doc, start, np.frombuffer(ids, "<u4"), total)
            out, number = _rows(full, number, True, kind)
            full = []
            yield out
        if kind is not None:
            rest = [w[1] for w in open_ones.windows]
            if last:
                # Nothing follows: the open windows are filled one after another.
                joined, rest = OpenWindows(1, window), []
                for pieces in [w[1] for w in open_ones.windows]:
                    for piece in pieces:
                        rest += joined.add(*piece)
                rest += [w[1] for w in joined.windows]
            out, number = _rows(rest, number, last, kind)
            yield out

    spark = docs.sparkSession
    pieces = stored(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
                    .mapInArrow(encode_and_pack, schema), "pieces")
    result = pieces.where("merged")
    groups = pieces.where("not merged").select(F.shiftright("sequence_id", 36).alias("part"))
    parts = (groups.agg(F.max("part")).first()[0] if docs.columns else None)
    if parts is None:
        return result.drop("merged")
    open_pieces, count, level = pieces.where("not merged"), parts + 1, 1
    while True:
        count = -(-count // MERGED_TOGETHER)
        last = count == 1
        part = F.shiftright("sequence_id", 36) % F.lit(1 << 24)
        dealt = (open_pieces.withColumn("group", F.floor(part / MERGED_TOGETHER).cast("int"))
                 .repartitionByRange(count, "group").sortWithinPartitions("sequence_id", "offset")
                 .drop("group") if not last else
                 open_pieces.coalesce(1).sortWithinPartitions("sequence_id", "offset"))
        merged = stored(dealt.mapInArrow(lambda b, last=last, level=level: merge(b, last, level),
                                         schema), "merged")
        result = result.unionByName(merged.where("merged"))
        if last:
            return result.drop("merged")
        open_pieces, level = merged.where("not merged"), min(level + 1, 6)

"""Token counts: proven whole tokens are counted directly, the rest is merged by the library."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import as_texts, once

MARK = "▁"
#: Bytes of the pre-tokens whose counts a worker keeps, and characters of the longest it does.
CACHE_BYTES, CACHE_CHARS = 48 << 20, 64
#: What a string and its count take beside the characters.
ENTRY_BYTES = 120


class PieceCounter:
    """Counts the pieces of a sentencepiece model text by text.

    The model marks blanks and puts one mark before the text; pieces never reach over the change from
    another symbol to a mark, and never hold a line feed, so a text falls into pre-tokens (marks
    and what follows, or a line feed and what follows) that are merged each on their own. Both facts
    are checked on the vocabulary; where they fail, whole texts go through the library.

    ``proven`` has the vocabulary strings that the library encodes alone as one token; it is worked out
    once (``prove``) and given to every worker. Counts of other pre-tokens are kept in a table of bounded
    bytes, longer ones never.
    """

    def __init__(self, path: str, proven: list[str] | None = None):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = (self.library.encode(" ", out_type=str) == [MARK * 2]
                       and not any("\n" in p or (MARK in p[1:] and p.strip(MARK)) for p in pieces)
                       and self.library.encode("a ▁\tb", out_type=str)[-1] == "b")
        self.proven = dict.fromkeys(self.prove(pieces) if proven is None else proven, 1)
        self.known, self.kept = dict(self.proven), 0

    def prove(self, pieces: list[str] | None = None) -> list[str]:
        """The words of the vocabulary that the library, asked once each, encodes alone as one token."""
        pieces = pieces or [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        return [w for w, ids in zip(words, self.library.encode(words, num_threads=1)) if len(ids) == 1]

    def pre_token(self, chunk: str) -> int:
        count = self.known.get(chunk)
        if count is None:
            # The mark that the library puts before a line feed is not in the text.
            count = len(self.library.encode(chunk)) - (chunk[0] == "\n")
            if len(chunk) <= CACHE_CHARS:
                if self.kept > CACHE_BYTES:
                    self.known, self.kept = dict(self.proven), 0
                self.known[chunk] = count
                self.kept += ENTRY_BYTES + 4 * len(chunk)
        return count

    def marks(self, n: int) -> int:
        return n if n < 2 else len(self.library.encode(" " * (n - 1)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        # A blank is put before every line feed; the loop takes it out again.
        chunks = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" not in chunks:
            known, total = self.known, 0
            for c in chunks:
                n = known.get(c)
                if n is None:
                    n = self.pre_token(c)
                    known = self.known
                total += n
            return total
        total = run = 0
        for c in chunks:
            run += 1
            if not c:
                continue
            if c[0] == "\n":
                total += self.marks(run - 1) + self.pre_token(c)
            elif run == 1:
                total += self.pre_token(c)
            else:
                total += len(self.library.encode(" " * (run - 1) + c))
            run = 0
        return total + self.marks(run)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens as the library counts, over_limit.

    A null text counts as empty: no bytes, no tokens. A very long text goes pre-token by pre-token; no count
    depends on other texts, so ties do not arise. Null or repeated ids keep their rows; other
    columns are neither read nor returned. An empty table gives an empty table.
    """
    path = public_tokenizers.path(model)
    proven = PieceCounter(path, []).prove()

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        counter = once(("pieces", path), lambda: PieceCounter(path, proven))
        return pa.array([counter.count(t) for t in as_texts(texts)], pa.int64())

    return docs.select(
        F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        tokens(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

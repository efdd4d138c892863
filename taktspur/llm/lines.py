"""Removal of lines that many documents share, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _joined_without(lines: str, dropped: str) -> Column:
    """The lines but those at the dropped places (ascending, from 1), joined by newlines.

    The stretches between dropped places are cut out whole, so the work follows the number of lines.
    """
    end = F.array(F.size(lines) + 1)
    stretches = F.zip_with(F.concat(F.array(F.lit(0)), dropped), F.concat(dropped, end),
                           lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n")))
    some = F.filter(stretches, lambda s: s["n"] > 0)
    return F.array_join(F.transform(some, lambda s: F.array_join(F.slice(lines, s["start"], s["n"]), "\n")), "\n")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept (the text that stays).

    Lines are parted by a newline. A line's key is the line without blanks at both ends, in lower
    case (A-Z). Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose
    all their lines except those of the document with the largest id that holds them.

    Keys are named by their md5 digest. A document names each of its keys once, then documents are
    counted per key, partly before the shuffle, so a key that all documents share is one row a task.
    Only keys over the threshold meet the lines again; where such a key is hot, the adaptive plan
    splits its lines. Texts move once, to meet the places of their dropped lines; no line text
    moves on its own.

    A null text is one empty line; so is an empty one. Every row is a document of its own, so a
    repeated row counts again, and rows that share the largest id all keep their lines. A null id is
    smaller than all others: its rows count, and keep a line only if no row with an id holds it. A
    very long text is one array of lines, each line handled once. Equal lines of one document count
    once and are dropped or kept together. An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Two hashes over id and text name a row; equal rows have equal lines to drop.
    named = texts.select("id", F.xxhash64("id", "text").alias("k1"),
                         F.xxhash64(F.lit(1), "text", "id").alias("k2"), F.split("text", "\n").alias("lines"))

    keys = F.filter(F.transform("lines", line_key), lambda key: F.char_length(key) >= min_chars)
    mentions = named.select("id", F.explode(F.array_distinct(F.transform(keys, F.md5))).alias("key"))
    common = stored(
        mentions.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs).select("key", "last"), "common-lines")

    places = (named.select("id", "k1", "k2", F.posexplode("lines").alias("at", "line"))
              .withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
              .select("id", "k1", "k2", (F.col("at") + 1).alias("at"), F.md5("line").alias("key")))
    dropped = (places.join(common, "key").where(~F.col("id").eqNullSafe(F.col("last")))
               .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("dropped")))
    both = named.join(dropped, ["k1", "k2"], "left").select(
        "id", "lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return both.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"), _joined_without("lines", "dropped").alias("kept"))

"""What filters remove alone, together and in every order, by path counts over the subset lattice."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MIN_WORDS = 200
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "[\\x20\\x09-\\x0D]+"
MOST_FILTERS = 7


def text_failures(text_col: str = "text") -> dict[str, Column]:
    """Conditions A to D on the whole text: few words, few distinct words, many capitals, symbols."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each set of applied filters: orders that reach it from none, and that lead from it to all."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(full)):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return forward, backward


def _edges(spark: SparkSession, letters: str) -> DataFrame:
    """(state, bit, ways, steps): applying a filter after a set of others.

    ``ways`` is the number of orders that take this edge, ``steps`` names them with the step. All in
    all n! * n steps on 2**(n - 1) * n edges, whatever the documents are.
    """
    n = len(letters)
    forward, backward = path_counts(n)
    steps: dict[tuple[int, int], list] = {}
    for order in permutations(range(n)):
        state, name = 0, "".join(letters[f] for f in order)
        for step, f in enumerate(order, 1):
            steps.setdefault((state, 1 << f), []).append((name, step))
            state |= 1 << f
    rows = [{"state": state, "bit": bit, "ways": forward[state] * backward[state | bit],
             "steps": [{"filter_order": name, "step": step} for name, step in taken]}
            for (state, bit), taken in steps.items()]
    assert all(len(row["steps"]) == row["ways"] for row in rows)
    # One value in the plan: no task of Python is needed to make the rows.
    kind = "array<struct<state: int, bit: int, ways: bigint, steps: array<struct<filter_order: string, step: int>>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("e")).select("e.*")


def audit(failures: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents.

    ``failures`` has ``part``, ``mask`` (bit i: fails filter i of ``letters``) and the flags ``good``
    and ``toxic``. Documents are counted by part and mask first; all else reads these at most 2**n
    rows a part. On the lattice of applied filters an edge (state, filter) removes the documents that
    fail the filter and none of the state. Orders reaching the state times orders leaving the edge's
    end weight its removals for ``shapley``; each step of an order is the edge it takes there.
    """
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"from one to {MOST_FILTERS} filters, as there are n! orders")
    masks = failures.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    edges = _edges(failures.sparkSession, letters)
    # The lattice has a fixed size, so each mask meets it as one value.
    lattice = edges.agg(F.collect_list(F.struct("state", "bit"))).scalar()
    at = masks.withColumn("edge", F.explode(lattice)).select("part", "mask", "n", "good", "toxic", "edge.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(value: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(value)).otherwise(0))

    counts = at.groupBy("part", "state", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"), total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"))
    on_edge = counts.join(F.broadcast(edges), ["state", "bit"])
    # At most 2**(n - 1) edges of one part and filter.
    same = Window.partitionBy("part", "bit")
    return (on_edge.withColumn("shapley", F.sum(F.col("removed") * F.col("ways")).over(same))
            .withColumn("at", F.explode("steps"))
            .select("part", "at.filter_order", "at.step", "kept", "removed", "redundant", "unique_fails",
                    "good_lost", "toxic_lost", "shapley"))


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of each row: failures of A to D, and of E for later copies of a text.

    E fails where the same text has a smaller id anywhere in the table. The smallest id of each text
    is found by partial sums before the shuffle and joined back by id and text together, so a text
    that a third of all rows share is no hot key there. Texts are compared by two 64-bit hashes.
    Labels of one id are put together first: good or toxic if any of them says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.lit(0)
    for i, failed in enumerate(text_failures(text_col).values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       mask.alias("mask"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    first = texts.groupBy("t1", "t2").agg(F.min("id").alias("id")).where("id is not null").withColumn("is_first", F.lit(True))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("id is not null")
    later = F.col("id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["id", "t1", "t2"], "left").join(marks, "id", "left").select(
        "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """Five filters in all 120 orders, one row per part, filter_order and step, zeros included.

    A: under 200 words; B: fewer than half of the words distinct; C: over 2 % capitals A-Z; D: holds
    one of ``#$%&*|``; E: the same text has a smaller id. Per step: kept, removed, redundant (fails
    this filter, removed earlier), unique_fails (fails this filter only), good_lost, toxic_lost, and
    shapley, this filter's removals summed over all orders.

    A null text is empty (and fails A); a null part is the empty string. Very long texts are read
    whole, once. Rows that repeat an id and a text are all first copies (none has a smaller id) and
    count each; a row without an id is never a later copy and has no labels. Ties do not arise, as
    only counts are returned. An empty table has no parts and gives no rows; other columns are not read.
    """
    return audit(document_failures(docs, labels, id_col, text_col, part_col), "ABCDE")

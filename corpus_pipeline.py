"""From raw documents to packed training sequences: five stages over the operators of ``taktspur.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

A stage decides by row, where a row is told by its id and text together (null is a value like others
for that): rows that share an id but not the text are different documents, and rows equal in both are one
document repeated, of which near-duplicate removal keeps one. Empty tables give empty tables, columns
beyond those of documents stay, and very long texts are read whole, as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taktspur.llm.common import crc_bucket, stored, with_small_batches
from taktspur.llm.contamination import contaminated, find_contamination
from taktspur.llm.near_dup import near_duplicates
from taktspur.llm.packing import pack
from taktspur.llm.pii import mask_personal_data
from taktspur.llm.toxicity import fit_toxicity, keep_clean
from taktspur.operators.joins import lookup
from taktspur.session import delete_run_dir, new_run_dir, scratch


ROW = "_row"


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but those whose row is in ``rows``, all columns unchanged."""
    return _with_row(docs).join(rows.select(ROW), ROW, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the classifier, fitted on labels outside the held-out fifth."""
    with_small_batches(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, usable=lambda column: crc_bucket(column, 5) != 0)
    return keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, null ids last; of repeated rows one."""
    with_small_batches(docs)
    keyed = _with_row(docs.select("doc_id", "text"))
    found = near_duplicates(keyed, id_col=ROW).groupBy(ROW).agg(
        F.min("component_id").alias("component"), F.count("*").alias("n"))
    named = found.join(keyed.groupBy(ROW).agg(F.min("doc_id").alias("doc_id")), ROW)
    # Ids are compared as they are, whatever their type; a group of any size is one row a task before the shuffle,
    # and its members are dealt into parts where they look up the first.
    first = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW)).alias("first"))
    decided = stored(lookup(named, first, ["component"], spread=ROW).select(
        ROW, "n", (F.col(ROW) == F.col(f"first.{ROW}")).alias("stays")).where("not stays or n > 1"), "decided")
    out = _without(docs, decided)
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return out
    one = (_with_row(docs).join(repeated.select(ROW), ROW, "left_semi").groupBy(ROW)
           .agg(F.first(F.struct(*docs.columns)).alias("d")).select("d.*"))
    return out.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than one word in twenty inside a passage of the benchmark."""
    found = find_contamination(_with_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return _without(docs, found.where(contaminated(found)))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return mask_personal_data(with_small_batches(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens, with its token ids."""
    return pack(with_small_batches(docs)).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_private),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own scratch data goes when its rows are written, and those go
    when the next stage's are."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_run_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete_run_dir(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs

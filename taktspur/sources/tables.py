"""Tables: optional inputs, replacement, parameterised SQL, counts."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


#: Quotes inside a quoted field are doubled, as in files of other programs.
CSV = {"sep": ";", "quote": '"', "escape": '"'}
#: A split size above that of any file: each file is one task's first and only split.
WHOLE_FILE = 1 << 45
_SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def _plain_path(name: str) -> str:
    """A file's name as Spark gives it, in one spelling and without percent signs, as readers want it."""
    return unquote(re.sub("^file:/+", "file:/", name))


def _first_lines(lines: DataFrame, once: bool) -> list:
    """(file, first non-blank line) per file of ``lines``; with ``once`` a task ends at its first one."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if not batch.num_rows or batch.column(0)[-1].as_py() == seen:
                continue
            files = batch.column(0).to_pylist()
            at = [i for i, file in enumerate(files) if file != (files[i - 1] if i else seen)]
            yield batch.take(pa.array(at))
            if once:
                return
            seen = files[-1]

    return lines.mapInArrow(first, lines.schema).collect()


def csv_headers(spark: SparkSession, path: str | list[str], sep: str = ";",
                encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their first line that is not blank; files without one are left out.

    Tasks find the lines, one task per file, which reads no more than one batch of its lines; the
    driver opens no file and gets one line for each. A split that starts inside a file has no
    header, so where the session splits files after all, their first splits are read through.
    """
    def lines_of(paths: str | list[str]) -> DataFrame:
        value = F.trim(F.translate("value", "\ufeff\r\t", ""))
        return (spark.read.text(paths).where("_metadata.file_block_start = 0")
                .select(F.col("_metadata.file_path").alias("file"), "value").where(value != "")
                .select("file", F.col("value").cast("binary").alias("line")))

    files = [_plain_path(f) for f in spark.read.text(path).inputFiles()]
    before = {k: spark.conf.get(k, None) for k in _SPLITS}
    for k in _SPLITS:
        spark.conf.set(k, str(WHOLE_FILE))
    try:
        rows = _first_lines(lines_of(path), once=True)
        # Files without a line, or further files of a task that holds several.
        known = {_plain_path(r["file"]) for r in rows}
        rest = [f for f in files if f not in known]
        rows += _first_lines(lines_of(rest), once=False) if rest else []
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted({(_plain_path(r["file"]), bytes(r["line"])) for r in rows}):
        text = bytes(line).decode(encoding, "replace").lstrip("\ufeff").rstrip("\r")
        names = next(csv.reader([text], delimiter=sep))
        found.setdefault(tuple(names), []).append(file)
    return found


def read_by_header(spark: SparkSession, path: str | list[str], key: str | None = None, sep: str = ";",
                   multi_line: bool = False, keep_file: str | None = None) -> list[DataFrame]:
    """One frame of text columns per kind of header; each file is read once, by its own names.

    Filters on these columns reach the file. A record with more cells than its header fails the read,
    as Spark would drop the last ones; a shorter one has nulls. A file whose header lacks ``key`` is an
    error. ``keep_file`` names a column for the path of the file.
    """
    frames = []
    for names, files in csv_headers(spark, path, sep).items():
        if key is not None and key not in names:
            raise ValueError(f"no column {key} in the header of {files[0]}")
        text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_whole"]])
        raw = (spark.read.options(**{**CSV, "sep": sep}).option("header", True).option("multiLine", multi_line)
               .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_whole").schema(text).csv(files))
        # A record of another width also comes as a whole, and its separators outside quotes count.
        bare = F.regexp_replace("_whole", rf'(^|\Q{sep}\E)\s*"(?:[^"]|"")*+"', "$1")
        parts = F.length(bare) - F.length(F.replace(bare, F.lit(sep)))
        wide = F.when(F.coalesce(parts, F.lit(0)) < len(names) * len(sep), True).otherwise(
            # Spark reads the whole record only beside a column of the file.
            F.raise_error(F.concat(F.lit(f"more than {len(names)} cells in a record of "), F.col("_metadata.file_path"),
                                   F.lit(" at "), F.coalesce(f"`{names[0]}`", F.lit("null")))).isNull())
        frames.append(raw.where(wide).select(
            *[F.col(f"`{n}`") for n in names], *([F.col("_metadata.file_path").alias(keep_file)] if keep_file else [])))
    return frames


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def project_optional(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[name for name in wanted if name in present])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of the schema in its types; absent ones become typed nulls."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def optional_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one of the same schema if nothing is stored yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty_table(spark, schema)
        raise
    return conform(stored, schema)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store the frame (if a path is given) and make it the view of that name."""
    if path is not None:
        df.write.mode("overwrite").parquet(path, compression="snappy")
        df = df.sparkSession.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str, params: dict | list | None = None) -> DataFrame:
    """SQL text with named or positional parameters."""
    return spark.sql(text, args=params)


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Row count per table; all views of the session unless names are given."""
    if names is None:
        names = sorted(t.name for t in spark.catalog.listTables())
    counts = [
        spark.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in names
    ]
    return reduce(DataFrame.unionAll, counts)

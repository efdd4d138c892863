"""Daily stop events: read, filter, parse, write."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.delay import known, seconds_between
from ..functions.time import parse_time
from ..schemas import RAW_EVENTS
from .tables import lower_names, read_by_header

#: Partition column that keeps the rows of one load together.
LOAD = "ladung"
TIME_COLUMNS = ["BETRIEBSTAG", "ANKUNFTSZEIT", "AN_PROGNOSE", "ABFAHRTSZEIT", "AB_PROGNOSE"]


def read_event_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_EVENTS,
                   sep: str = ";", multi_line: bool = False, key: str | None = None,
                   keep_file: str | None = None) -> DataFrame:
    """Feed files with a header line each; columns are matched by name to the fixed types.

    Files are grouped by header and the groups united by name: the order of columns may differ, a
    column that a file lacks is null there, and columns beyond the schema are kept as text.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    groups = [raw.select(*[F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`")
                           for n in raw.columns])
              for raw in read_by_header(spark, path, key, sep, multi_line, keep_file)]
    if not groups:
        return spark.createDataFrame([], schema)
    united = union_days(groups)
    absent = [f for f in schema.fields if f.name not in united.columns]
    return united.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})


def kept_rows(product: str, operator: str, product_col: str = "PRODUKT_ID",
              operator_col: str = "BETREIBER_ABK") -> Column:
    """Condition of the source filter; both equalities reach the file. It is null, and so not
    met, where the product or the operator is unknown."""
    return (F.col(product_col) == product) & (F.col(operator_col) == operator)


def with_parsed_times(df: DataFrame, columns: list[str] = TIME_COLUMNS) -> DataFrame:
    present = set(df.columns)
    return df.withColumns({c: parse_time(c) for c in columns if c in present})


def with_delays(df: DataFrame, pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Delay columns as seconds from planned to actual time."""
    pairs = pairs or {
        "delay_arr_sec": ("ANKUNFTSZEIT", "AN_PROGNOSE"),
        "delay_dep_sec": ("ABFAHRTSZEIT", "AB_PROGNOSE"),
    }
    return df.withColumns({out: seconds_between(plan, real) for out, (plan, real) in pairs.items()})


def ingest(raw: DataFrame, product: str, operator: str) -> DataFrame:
    """Raw feed rows to stop events: filter, parse, delays, lower-case names."""
    kept = with_delays(with_parsed_times(raw.where(kept_rows(product, operator))))
    events = lower_names(kept)
    return events.withColumn("betriebstag", F.col("betriebstag").cast("date"))


def ingest_summary(raw: DataFrame, keep: Column) -> DataFrame:
    """Raw rows, kept rows and the kept share in percent."""
    raw_rows, kept = F.count("*"), F.count_if(keep)
    return raw.agg(
        raw_rows.alias("raw_rows"),
        kept.alias("kept_rows"),
        (100.0 * kept / F.greatest(raw_rows, F.lit(1))).alias("kept_pct"),
    )


def write_days(events: DataFrame, path: str, day: str = "betriebstag", load: str | None = None) -> None:
    """Snappy Parquet, one folder per operating day and load; only the folders present are replaced.

    ``load`` names a column that says where a row comes from, such as its file: loading a file again
    replaces its rows, and neither a day that comes in two files nor rows without a readable day
    push out rows of other files. Without it the days present are replaced as a whole, and rows
    without a day are added to those of earlier calls, under a name of their own.

    Rows are brought together by day, but in tasks of about equal size: the adaptive plan
    splits a day that holds far more rows than others and joins small days.
    """
    if load is None:
        load = LOAD
        own = F.when(F.col(day).isNull(), F.lit(uuid.uuid4().hex)).otherwise(F.lit("-"))
        events = events.withColumn(load, own)
    (events.hint("rebalance", day, load)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day, load).parquet(path, compression="snappy"))


def read_days(spark: SparkSession, path: str, schema: T.StructType | None = None,
              load: str = LOAD) -> DataFrame:
    """The rows written by ``write_days``, without the column of the load."""
    reader = spark.read if schema is None else spark.read.schema(
        T.StructType([f for f in schema.fields if f.name != load] + [T.StructField(load, T.StringType())]))
    return reader.parquet(path).drop(load)


def union_days(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column absent in some is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN to null in the named columns."""
    return df.withColumns({c: known(c) for c in columns})

"""Load only the daily files that have not been loaded before.

The file source remembers in its checkpoint which files it has read, so each run
takes the new days and stops. A run that is lost midway is repeated from the
checkpoint, and a repeated batch replaces the rows it had begun to write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import RAW_EVENTS
from ..sources.events import LOAD, ingest, read_event_csv, write_days

_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_event_files(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of feed files as a stream; no content is read for it."""
    return spark.readStream.format("binaryFile").schema(_FILES).load(folder).select("path")


def load_new_days(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                  product: str, operator: str, schema: T.StructType = RAW_EVENTS,
                  key: str = "BETRIEBSTAG", multi_line: bool = False) -> None:
    """Ingest every file not seen before into the table by day and file, then stop.

    The stream says which files are new; each is then read once, by its own header and with the filter
    pushed into the scan. Rows stay with their file: a day that comes in several files, and rows
    without a readable day, are all kept, and a file loaded again replaces only itself.
    """

    def store(batch: DataFrame, _: int) -> None:
        # The names of the new files, which the source lists on the driver anyway.
        files = [r["path"] for r in batch.collect()]
        if not files:
            return
        raw = read_event_csv(spark, files, schema, multi_line=multi_line, key=key, keep_file=LOAD)
        if LOAD in raw.columns:
            rows = ingest(raw.select(*schema.fieldNames(), LOAD), product, operator)
            # The name alone would mix files of two folders.
            write_days(rows.withColumn(LOAD, F.sha1(LOAD)), table_path, load=LOAD)

    query = (new_event_files(spark, folder).writeStream.foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()

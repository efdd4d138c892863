"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import sys
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "taktspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even where that costs one more shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Checkpoint files go when the frame that reads them does.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # The call-site capture doubles the time it takes to build a wide plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only used when Spark itself runs in this one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="taktspur-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """The frame written once to the checkpoint folder and read from there afterwards.

    Used for small intermediate tables that several later steps read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    # A folder of this application alone.
    _delete_later(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


#: Run folders of the innermost ``scratch`` block, and those made outside of any.
_made: ContextVar[list[str] | None] = ContextVar("run folders", default=None)
_outside: dict[str, None] = {}


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call gives another one.

    It is deleted at the end of the ``scratch`` block it is made in; outside of any, when the driver's
    program ends.
    """
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    block = _made.get()
    if block is None:
        _delete_later(spark, path)
    else:
        block.append(path)
    return path


def _delete_later(spark: SparkSession, path: str) -> None:
    if not _outside:
        atexit.register(_delete_at_exit, spark)
    _outside[path] = None


def delete_run_dir(spark: SparkSession, path: str) -> None:
    """Removes the folder through the file system of its path, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _delete_at_exit(spark: SparkSession) -> None:
    try:
        for path in _outside:
            delete_run_dir(spark, path)
    except Exception as error:  # The JVM may be gone by now; then the folders stay, and are named.
        print(f"run folders left, such as {next(iter(_outside))}: {type(error).__name__}", file=sys.stderr)


@contextmanager
def scratch(spark: SparkSession):
    """Run folders made inside are deleted at the end: for work whose result is written by then.

    Frames that read such folders are of no use afterwards.
    """
    mine: list[str] = []
    token = _made.set(mine)
    try:
        yield
    finally:
        _made.reset(token)
        for path in mine:
            delete_run_dir(spark, path)

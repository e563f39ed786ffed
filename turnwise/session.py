"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "turnwise", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; ``master`` only for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _private_folder() -> str:
    """For local runs without a shared folder; removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="turnwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a private one where driver and executor are one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _private_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at a time
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is run inside sends rows to Python in Arrow batches of about ``size`` bytes at most, one row at least.

    By number of rows alone a batch of texts takes tens of MB, several times over: in the JVM, in
    Python and as its objects.  A limit that the session has already stays.
    """
    if spark.conf.get(BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(BATCH_CONF, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from there.

    The table survives lost executors, later reads prune its columns, and its size is known to the
    planner.
    """
    folder = new_folder(df.sparkSession, "stage")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_texts(df: DataFrame) -> DataFrame:
    """``cut_lineage`` where Python tasks take wide rows, such as whole texts: in small batches."""
    with small_batches(df.sparkSession):
        return cut_lineage(df)

"""Stored intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHARED_SETTING = "spark.checkpoint.dir"
_made: ContextVar[list[str] | None] = ContextVar("stored_tables", default=None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only in local mode, where one process holds driver and executors, is a folder made if none is named."""
    base = spark.conf.get(SHARED_SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{SHARED_SETTING} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parapet-shared-")
        spark.conf.set(SHARED_SETTING, base)
    return f"{base.rstrip('/')}/parapet-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block are deleted at its end; what is still wanted must have been written elsewhere by then."""
    outer = _made.get()
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            _delete(spark, path)
        _made.reset(token)
        assert _made.get() is outer


def release(spark: SparkSession) -> None:
    """Delete this application's stored tables; DataFrames that were read from them can't be used any more."""
    _delete(spark, shared_dir(spark))

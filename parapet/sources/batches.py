"""Batches of several tables that become visible together.

Each table lies under `root/table/<by>=.../commit=.../`. A batch is first written to all of its tables under a commit name of its own; then
one manifest, named after the batch, is put in place by a rename. Readers see the commits that a manifest names, and nothing else: a batch that
breaks off between its tables leaves no row visible, what it wrote is never read, and when it runs again it writes afresh. A batch whose
manifest is there is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.sources.shared import stored

MANIFEST = "batch string, commit string, replaces array<string>, rows map<string,long>"


def _fs(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _fs(spark, path)
    return fs.exists(there)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """batch, commit, replaces, rows of what is visible: manifests whose commit no other one replaces."""
    if not exists(spark, f"{root}/_batches"):
        return spark.createDataFrame([], MANIFEST)
    all_ = spark.read.schema(MANIFEST).json(f"{root}/_batches")
    return all_.join(all_.select(F.explode("replaces").alias("commit")), "commit", "left_anti")


def read(spark: SparkSession, root: str, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The committed rows of a table, with `commit`. Without a schema the table must have files."""
    path = f"{root}/{table}"
    if schema is None:
        rows = spark.read.parquet(path)
    else:
        known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        full = T.StructType([*known.fields, T.StructField("commit", T.StringType())])
        rows = spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)
    return rows.join(commits(spark, root).select("commit"), "commit", "left_semi")


def _write(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("append").partitionBy(by, "commit").parquet(path)


def _publish(spark: SparkSession, root: str, batch: str, content: dict) -> bool:
    """The manifest appears whole or not at all; False if the batch has one already."""
    fs, place = _fs(spark, f"{root}/_batches/{batch}.json")
    if fs.exists(place):
        return False
    _, draft = _fs(spark, f"{root}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.mkdirs(place.getParent())
    return bool(fs.rename(draft, place))


def commit(root: str, batch: str, tables: dict[str, DataFrame], by: str, replaces: list[str] | None = None) -> bool:
    """Write a batch's tables (each with the column `by`) and make them visible at once. False if the batch was committed before: then nothing
    is written. Tables should be stored ones: they are counted and written."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{root}/_batches/{batch}.json"):
        return False
    own, rows = f"{batch}-{uuid.uuid4().hex[:12]}", {}
    for name, df in tables.items():
        _write(df.withColumn("commit", F.lit(own)), f"{root}/{name}", by)
        rows[name] = df.count()
    return _publish(spark, root, batch, {"batch": batch, "commit": own, "replaces": replaces or [], "rows": rows})


def new_rows(df: DataFrame, root: str, table: str, key: list[str], by: str) -> DataFrame:
    """The rows whose key isn't committed yet, each key once; NUL characters are dropped. Only the partitions of the batch's own values of `by`
    are read, so a key must not change its `by`."""
    spark = df.sparkSession
    clean = df.withColumns({f.name: F.translate(f.name, "\u0000", "") for f in df.schema if f.dataType.typeName() == "string"}).dropDuplicates(key)
    clean = stored(clean, "batch")
    days = clean.select(by).distinct()
    old = read(spark, root, table, df.select(*key, by).schema).join(F.broadcast(days) if days.count() < 10_000 else days, by, "left_semi")
    return stored(clean.join(old.select(*key), key, "left_anti"), "new")


def gather(spark: SparkSession, root: str, batch: str, tables: list[str], by: str, where: Callable[[DataFrame], DataFrame] = lambda x: x) -> bool:
    """Rewrite all visible commits as one (fewer, larger files), itself a batch: readers see the old commits or the new one, never both."""
    old = [r.commit for r in commits(spark, root).collect()]  # a row for each batch since it was last gathered
    if not old:
        return False
    return commit(root, batch, {t: stored(where(read(spark, root, t)).drop("commit").repartition(by, F.pmod(F.xxhash64(*_keys(spark, root, t)), F.lit(4))), t) for t in tables}, by, old)


def _keys(spark: SparkSession, root: str, table: str) -> list[str]:
    return [f.name for f in read(spark, root, table).schema if f.name != "commit" and f.dataType.typeName() != "map"]


def abandoned(spark: SparkSession, root: str, table: str) -> list[str]:
    """Commits of a table that no manifest names, or that were replaced: their folders can go once no batch is under way and no reader left."""
    rows = spark.read.parquet(f"{root}/{table}").select("commit").distinct()
    return sorted(r.commit for r in rows.join(commits(spark, root), "commit", "left_anti").collect())

"""Readers and writers of stored corpora, lists and history."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.sources.shared import stored

HISTORY = "at timestamp, sender string, reply_to string, direction string, verdict string, auth_failed boolean"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sender events."""
    return spark.read.schema(HISTORY).json(path).select(F.col("at").alias("occurred_at"), F.lower("sender").alias("sender"), F.lower("reply_to").alias("reply_to"), "direction", "verdict", "auth_failed")


def read_list(spark: SparkSession, path: str, kind: str = "lines", only: str | None = None) -> DataFrame:
    """value: one for each line (`lines`; # starts a comment, a URL gives its host) or the first, second, ... column (`csv1`, `csv2`, ...).
    `only` keeps lines that match a pattern, before anything else."""
    text = spark.read.text(path).select(F.trim("value").alias("value"))
    if only:
        text = text.where(F.rlike("value", F.lit(only)))
    text = text.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    if kind != "lines":
        text = text.select(F.trim(F.get(F.split("value", ","), F.lit(int(kind.removeprefix("csv")) - 1)), F.lit('" ')).alias("value"))
    host = F.regexp_extract("value", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return text.select(F.when(host != "", host).otherwise(F.col("value")).alias("value")).where("value != ''").distinct()


def read_suffixes(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """Rules of a public suffix list: a rule to a line, up to the first white space; `//` starts a comment. The list is part of a plan, so a
    file with more rules than `most` is refused."""
    rule = F.regexp_extract("value", r"^\s*(\S+)", 1)
    found = spark.read.text(path).select(rule.alias("rule")).where((F.col("rule") != "") & ~F.startswith("rule", F.lit("//"))).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules in {path}")
    return [r.rule for r in found]


def read_rules(folder: str) -> tuple[list[dict], dict[str, str]]:
    """Rule files (YAML with name, severity, type, when: a Spark SQL condition); broken files are reported by path."""
    import yaml

    good, broken = [], {}
    for path in sorted(Path(folder).rglob("*.yml")):
        try:
            rule = yaml.safe_load(path.read_text())
            if not isinstance(rule, dict) or not rule.get("name") or not rule.get("when"):
                raise ValueError("name and when are required")
            good.append(rule)
        except Exception as e:
            broken[str(path)] = str(e).splitlines()[0]
    return good, broken


def sql_rules(folder: str):
    """Rules of a folder as rules.Rule: conditions are Spark SQL expressions, so Spark's own parser reads them."""
    from parapet.operators.rules import Rule

    good, broken = read_rules(folder)
    out = []
    for r in good:
        try:
            out.append(Rule(r["name"], lambda t, when=r["when"]: F.expr(when), r.get("severity", "medium"), r.get("type", "rule"), tuple(r.get("needs", ()))))
        except ValueError as e:
            broken[r["name"]] = str(e)
    return out, broken


def append_new(df: DataFrame, path: str, key: list[str], by: str, batch: str) -> DataFrame:
    """Write the rows whose key is not stored yet (each key once) below `by`=value/batch=`batch`; NUL characters are dropped. Returns them.

    Only the partitions of the batch's own values of `by` are read, so a key must not change its `by`. What this batch wrote before
    doesn't count as stored and is overwritten: a batch that runs again, even after it broke off half-way, leaves the same rows.
    """
    spark = df.sparkSession
    clean = df.withColumns({f.name: F.translate(f.name, "\u0000", "") for f in df.schema if f.dataType.typeName() == "string"}).dropDuplicates(key)
    clean = stored(clean, "batch")
    days = [r[0] for r in clean.select(by).distinct().collect()]  # a batch spans few days
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.schema(T.StructType([*df.select(*key, by).schema.fields, T.StructField("batch", T.StringType())])).parquet(path)
        old = old.where(F.col(by).isin(days) & (F.col("batch") != batch)) if days else old.where("false")
        new = stored(clean.join(old.select(*key), key, "left_anti"), "new")
    else:
        new = clean
    out = new.withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)
    return new


def compact(spark: SparkSession, path: str, by: str, target: str) -> None:
    """Rewrite a table to `target` with a few files for each partition; a hot partition is still cut by its rows."""
    df = spark.read.parquet(path)
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.mode("overwrite").partitionBy(by).parquet(target)

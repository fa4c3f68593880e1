"""Named lists: set algebra without case, and membership for lists too long to write out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 10_000  # values up to which a list is broadcast


def resolve(base: DataFrame, include: DataFrame, exclude: DataFrame, column: str = "value") -> DataFrame:
    """(base + include) - exclude; the first spelling wins (base before include, then by text); an exclusion beats an inclusion."""
    both = base.select(F.col(column), F.lit(0).alias("_at")).unionByName(include.select(F.col(column), F.lit(1).alias("_at"))).where(F.col(column).isNotNull())
    folded = both.groupBy(F.lower(column).alias("_k")).agg(F.min_by(column, F.struct("_at", column)).alias(column))
    gone = exclude.select(F.lower(column).alias("_k")).distinct()
    return folded.join(gone, "_k", "left_anti").select(column)


def first_known(*candidates: DataFrame) -> DataFrame | None:
    """The first list of a fallback chain that has a value; None (unknown) if none has."""
    return next((c for c in candidates if not c.isEmpty()), None)


def flag_members(df: DataFrame, column: str, values: DataFrame, out: str, value: str = "value") -> DataFrame:
    """Adds `out`: whether the column is in the list, without case; null is in no list. Broadcast only if the list's size is small."""
    folded = values.select(F.lower(value).alias("_k")).where("_k is not null").distinct().withColumn("_in", F.lit(True))
    if folded.limit(SMALL + 1).count() <= SMALL:
        folded = F.broadcast(folded)
    return df.join(folded, F.lower(column) == F.col("_k"), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_k", "_in")

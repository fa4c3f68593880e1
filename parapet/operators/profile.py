"""Sender history as of a moment: only events strictly before it count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def day_difference(later: Column, earlier: Column) -> Column:
    """Whole days, floored, never negative."""
    return F.greatest(F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY), F.lit(0)).cast("long")


def prevalence(n: Column) -> Column:
    return F.when(n == 0, "new").when(n < 3, "outlier").otherwise("common")


def fold() -> dict[str, Column]:
    """Aggregates of a sender's events."""
    return {
        "n_events": F.count("*"),
        "first_contact": F.min("occurred_at"),
        "last_contact": F.max("occurred_at"),
        "last_inbound": F.max(F.when(F.col("direction") == "inbound", F.col("occurred_at"))),
        "last_outbound": F.max(F.when(F.col("direction") == "outbound", F.col("occurred_at"))),
        "solicited": F.bool_or(F.col("direction") == "outbound"),
        "any_malicious": F.bool_or(F.col("verdict") == "malicious"),
        "any_benign": F.bool_or(F.col("verdict") == "benign"),
        "any_false_positive": F.bool_or(F.col("verdict") == "false_positive"),
        "all_auth_failed": F.bool_and("auth_failed"),
    }


def profiles(events: DataFrame, key: str = "sender") -> DataFrame:
    """Per sender, over all events: the state that a stream of events adds up to."""
    return events.groupBy(F.lower(key).alias(key)).agg(*[c.alias(n) for n, c in fold().items()])


#: How a sender's earlier days and the day's earlier events add up.
ADD_UP = {
    "n_events": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "solicited": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
    "all_auth_failed": lambda a, b: F.coalesce(a & b, a, b),
} | {n: F.least for n in ("first_contact",)} | {n: F.greatest for n in ("last_contact", "last_inbound", "last_outbound")}
ADD_UP |= {n: ADD_UP["solicited"] for n in ("any_malicious", "any_benign", "any_false_positive")}
OVER_DAYS = {"n_events": F.sum, "first_contact": F.min, "all_auth_failed": F.bool_and} | {n: F.max for n in ("last_contact", "last_inbound", "last_outbound")} | {n: F.bool_or for n in ("solicited", "any_malicious", "any_benign", "any_false_positive")}


def _seen_before(rows: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """rows (key, `_t` in microseconds) with prior_<name>: the aggregate over the key's rows strictly before.

    A key's rows are summed by day; running totals go over its days, and a window over the events of one day at a time. So no task has
    to hold a busy sender's whole history in order."""
    rows = rows.withColumn("_day", F.floor(F.col("_t") / DAY))
    days = rows.groupBy(key, "_day").agg(*[c.alias(n) for n, c in aggregates.items()])
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col(key).alias("_key"), F.col("_day").alias("_d"), *[OVER_DAYS[n](n).over(earlier).alias(f"_{n}") for n in aggregates])
    today = Window.partitionBy(key, "_day").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[c.over(today).alias(f"prior_{n}") for n, c in aggregates.items()])
    joined = inside.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_day").eqNullSafe(F.col("_d")))
    return joined.withColumns({f"prior_{n}": ADD_UP[n](F.col(f"_{n}"), F.col(f"prior_{n}")) for n in aggregates}).drop("_key", "_d", "_day", *[f"_{n}" for n in aggregates])


def as_of_events(events: DataFrame, key: str = "sender") -> DataFrame:
    """Each event with the profile of its sender just before it; events at the same moment don't see each other."""
    keyed = events.withColumn("_own", F.lower(key)).withColumn("_t", F.unix_micros("occurred_at"))
    out = _seen_before(keyed, "_own", fold()).drop("_own", "_t")
    return out.withColumn("prevalence", prevalence(F.col("prior_n_events"))).withColumn("days_known", day_difference(F.col("occurred_at"), F.col("prior_first_contact")))


def as_of(messages: DataFrame, at: str, events: DataFrame, key: str = "sender") -> DataFrame:
    """messages (key, at) with the number of earlier events and the first and last of them.

    Both tables are laid into one and summed by day, so no message meets all of its sender's events in a join.
    """
    keep = [c for c in messages.columns if c != key]
    m = messages.select(F.lower(key).alias(key), F.unix_micros(at).alias("_t"), F.lit(None).cast("timestamp").alias("_e"), F.struct(*keep).alias("_m"))
    e = events.select(F.lower(key).alias(key), F.unix_micros("occurred_at").alias("_t"), F.col("occurred_at").alias("_e"))
    seen = _seen_before(m.unionByName(e, allowMissingColumns=True), key, {"n_events": F.count("_e"), "first_contact": F.min("_e"), "last_contact": F.max("_e")})
    return seen.where("_m is not null").select(key, "_m.*", "prior_n_events", "prior_first_contact", "prior_last_contact", prevalence(F.col("prior_n_events")).alias("prevalence"))

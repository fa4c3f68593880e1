"""Messages as a stream: rules, idempotent storage, running sender profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parapet.operators.rules import Rule, evaluate
from parapet.sources import batches
from parapet.sources.shared import passing, stored


def message_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def sender_events(judged: DataFrame) -> DataFrame:
    """One event of each message's sender, from what the message has of it: occurred_at, day, sender_email, sender_domain, reply_to, direction,
    verdict, auth_failed."""
    kinds = {"received_at": "timestamp", "sender_email": "string", "sender_domain": "string", "reply_to": "string", "direction": "string", "auth_failed": "boolean"}
    of = {c: F.col(c).cast(k) if c in judged.columns else F.lit(None).cast(k) for c, k in kinds.items()}
    return judged.select(
        "message_id", "day", F.coalesce(of["received_at"], F.col("day").cast("timestamp")).alias("occurred_at"), F.lower(of["sender_email"]).alias("sender_email"), F.lower(of["sender_domain"]).alias("sender_domain"),
        F.lower(of["reply_to"]).alias("reply_to"), F.coalesce(of["direction"], F.lit("inbound")).alias("direction"), "verdict", F.coalesce(of["auth_failed"], F.lit(False)).alias("auth_failed"),
    )


TABLES = ("messages", "verdicts", "sender_events")


def store_batch(df: DataFrame, rules: list[Rule], target: str, batch: str) -> bool:
    """Messages that aren't stored yet, their verdicts and their senders' events, made visible by one manifest."""
    if batches.exists(df.sparkSession, f"{target}/_batches/{batch}.json"):
        return False
    with passing(df.sparkSession):
        new = batches.new_rows(df, target, "messages", ["message_id"], "day")
        judged = stored(evaluate(new, rules, new.columns), "judged")
        verdicts = judged.select("message_id", "day", "verdict", "matched", "excluded_by", "indeterminate", "missing")
        return batches.commit(target, batch, {"messages": new, "verdicts": verdicts, "sender_events": sender_events(judged)}, "day")


def store(messages: DataFrame, rules: list[Rule], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Messages, verdicts and sender events of each batch are stored once for each message_id, also when a batch runs again; readers
    (sources.batches.read) see all three tables of a batch or none."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: store_batch(df, rules, target, f"{name}-{number}") and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


PROFILE = "sender string, n_events long, first_contact timestamp, last_contact timestamp, solicited boolean, any_malicious boolean, any_benign boolean"
STATE = "n long, first long, last long, solicited boolean, malicious boolean, benign boolean"


def running_profiles(events: DataFrame) -> DataFrame:
    """Sender profiles in update mode, with one small state for each sender; duplicates within a week of the watermark count once."""
    seen = events.withWatermark("occurred_at", "7 days").dropDuplicatesWithinWatermark(["event_id"])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, solicited, bad, good = state.get if state.exists else (0, None, None, False, False, False)
        for f in frames:
            t = f["occurred_at"].astype("datetime64[us]").astype("int64")
            n += len(f)
            first = int(t.min()) if first is None else min(first, int(t.min()))
            last = int(t.max()) if last is None else max(last, int(t.max()))
            solicited |= bool((f["direction"] == "outbound").any())
            bad |= bool((f["verdict"] == "malicious").any())
            good |= bool((f["verdict"] == "benign").any())
        state.update((n, first, last, solicited, bad, good))
        yield pd.DataFrame({"sender": [key[0]], "n_events": [n], "first_contact": [pd.Timestamp(first, unit="us")], "last_contact": [pd.Timestamp(last, unit="us")], "solicited": [solicited], "any_malicious": [bad], "any_benign": [good]})

    keyed = seen.withColumn("sender", F.lower("sender"))
    return keyed.groupBy("sender").applyInPandasWithState(fold, PROFILE, STATE, "update", GroupStateTimeout.NoTimeout)


def in_sender_order(messages: DataFrame, profile_of, sink) -> DataFrame:
    """For foreachBatch: a batch's messages by sender and time, each with what the sender had sent before it (the stored history and what
    came earlier in the batch), handed to `sink`. profile_of(senders) gives sender and n_events as stored."""
    ordered = messages.withColumn("sender", F.lower("sender")).repartition("sender").sortWithinPartitions("sender", "occurred_at", "event_id")
    w = Window.partitionBy("sender").orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    stored_counts = profile_of(ordered.select("sender").distinct()).select("sender", F.col("n_events").alias("_stored"))
    out = ordered.withColumn("_here", F.count("*").over(w)).join(stored_counts, "sender", "left").withColumn("n_before", F.coalesce("_stored", F.lit(0)) + F.col("_here")).drop("_stored", "_here")
    sink(out)
    return out


def take_over(claims: DataFrame, now, stale: str = "10 minutes") -> DataFrame:
    """Work that nobody has: never claimed, or claimed by one who has not been heard of for `stale`, and not done. claims: id, claimed_at,
    heard_at, done, total; adds the progress."""
    silent = F.coalesce("heard_at", "claimed_at") <= now - F.expr(f"interval {stale}")
    open_ = claims.where((F.col("done") < F.col("total")) & (F.col("claimed_at").isNull() | silent))
    return open_.withColumn("progress", F.try_divide(F.col("done").cast("double"), F.col("total").cast("double")))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", size), "verdict").count()


def due_visits(watches: DataFrame, now, most: int | None = 25, claims: DataFrame | None = None) -> DataFrame:
    """Links to visit again: first after 30 minutes, then every 6 hours, 4 times in all; the longest due first, `most` a round (None: all), and
    none that somebody has claimed for this attempt. watches: url, added_at, attempts, last_at; claims: url, attempt. Adds attempt and due."""
    after = F.when(F.col("attempts") == 0, F.unix_micros("added_at") + 1_800_000_000).otherwise(F.unix_micros("last_at") + 21_600_000_000)
    due = watches.withColumns({"attempt": F.col("attempts") + 1, "due": F.timestamp_micros(after)}).where((F.col("attempts") < 4) & (after <= F.unix_micros(now)))
    if claims is not None:
        due = due.join(claims.select("url", "attempt"), ["url", "attempt"], "left_anti").select(*watches.columns, "attempt", "due")
    return due if most is None else due.orderBy("due", "url").limit(most)

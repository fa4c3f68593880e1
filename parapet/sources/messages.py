"""Message-shaped views over the tables of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.sources.shared import read_table


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as messages, a day apart for each thousand ids modulo 30 days."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    received = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 30) * 86400 + F.col("doc_id") % 86400)
    triage = F.when(F.col("toxic") == 1, "needs_remediation").when(F.col("quality") == 0, "benign").otherwise("unreviewed")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("message_id"),
        received.alias("received_at"),
        F.to_date(received).alias("day"),
        F.concat(F.lit("user"), (F.col("doc_id") % 97).cast("string"), F.lit("@"), F.col("source"), F.lit(".example.com")).alias("sender_email"),
        F.concat("source", F.lit(".example.com")).alias("sender_domain"),
        F.substring_index("text", " ", 6).alias("subject"),
        F.when(F.col("doc_id") % 5 == 0, "outbound").otherwise("inbound").alias("direction"),
        "lang",
        F.col("text").alias("body"),
        triage.alias("triage"),
    )


def v_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def v_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an array of their lines; null for an order without any."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))
    return read_table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")


def v_sender_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("user_id").cast("string").alias("sender"),
        F.when(kind == "purchase", "outbound").otherwise("inbound").alias("direction"),
        F.when(kind == "error", "malicious").when(kind == "view", "benign").otherwise("").alias("verdict"),
        (F.col("value") < 10).alias("auth_failed"),
    )


def org_direction(sender_domain, recipient_domains, org_domains: list[str]):
    """inbound, internal, outbound flags of a message; null without an organisation. A domain is the organisation's if it is equal or below."""
    if not org_domains:
        none = F.lit(None).cast("boolean")
        return F.struct(none.alias("inbound"), none.alias("internal"), none.alias("outbound"))

    def own(d):
        out = F.lit(False)
        for o in org_domains:
            out = out | (F.lower(d) == o.lower()) | F.endswith(F.lower(d), F.lit("." + o.lower()))
        return out

    inside = own(sender_domain)
    return F.struct((~inside).alias("inbound"), (inside & F.exists(recipient_domains, own)).alias("internal"), (inside & F.exists(recipient_domains, lambda d: ~own(d))).alias("outbound"))

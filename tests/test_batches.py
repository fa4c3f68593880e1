"""Batches of three tables: visible together or not at all, once for each message, also after a break."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parapet.operators import rules
from parapet.sources import batches
from parapet.streaming import ingest

RULES = [rules.Rule("bad", lambda t: F.contains("body", F.lit("bad")), "high")]
SCHEMA = "message_id long, day date, received_at timestamp, sender_email string, direction string, body string"


def rows(ids):
    return [(i, dt.date(2024, 1, 1 + i % 3), dt.datetime(2024, 1, 1 + i % 3, 5), f"S{i % 4}@X.test", "outbound" if i % 5 == 0 else "inbound", "bad\0" if i % 7 == 0 else "ok") for i in ids]


def seen(spark, root):
    return {t: sorted(r[0] for r in batches.read(spark, root, t).select("message_id").collect()) for t in ingest.TABLES}


@pytest.mark.parametrize("broken", ["messages", "verdicts", "sender_events", "manifest"])
def test_a_batch_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "out")
    assert ingest.store_batch(spark.createDataFrame(rows(range(10)), SCHEMA), RULES, root, "b-0")
    before = seen(spark, root)
    more = spark.createDataFrame(rows(range(5, 30)), SCHEMA)
    write, publish = batches._write, batches._publish

    def fails(df, path, by):
        write(df, path, by)  # what it wrote stays behind
        if path.endswith(broken):
            raise OSError("lost")

    def lost(*a):
        if broken == "manifest":
            raise OSError("lost")
        return publish(*a)

    monkeypatch.setattr(batches, "_write", fails)
    monkeypatch.setattr(batches, "_publish", lost)
    with pytest.raises(OSError):
        ingest.store_batch(more, RULES, root, "b-1")
    monkeypatch.undo()
    assert seen(spark, root) == before
    left = {t: len(batches.abandoned(spark, root, t)) for t in ingest.TABLES}
    assert sum(left.values()) > 0

    assert ingest.store_batch(more, RULES, root, "b-1")
    assert seen(spark, root) == {t: list(range(30)) for t in ingest.TABLES}
    assert not ingest.store_batch(more, RULES, root, "b-1")  # committed: nothing is written again
    assert ingest.store_batch(more, RULES, root, "b-2") and seen(spark, root) == {t: list(range(30)) for t in ingest.TABLES}
    assert {r.batch: r.rows for r in batches.commits(spark, root).collect()}["b-1"] == dict.fromkeys(ingest.TABLES, 20)


def test_what_is_stored(spark, tmp_path):
    root = str(tmp_path / "out")
    data = spark.createDataFrame(rows([0, 1, 7, 7]), SCHEMA)
    ingest.store_batch(data, RULES, root, "b")
    assert {(r.message_id, r.verdict, tuple(r.matched)) for r in batches.read(spark, root, "verdicts").collect()} == {(0, "malicious", ("bad",)), (1, "clean", ()), (7, "malicious", ("bad",))}
    events = {r.message_id: r for r in batches.read(spark, root, "sender_events").collect()}
    assert (events[0].sender_email, events[0].direction, events[0].verdict, events[0].auth_failed, events[0].occurred_at) == ("s0@x.test", "outbound", "malicious", False, dt.datetime(2024, 1, 1, 5))
    assert {r.body for r in batches.read(spark, root, "messages").collect()} == {"bad", "ok"}
    none = spark.createDataFrame([], SCHEMA)
    assert ingest.store_batch(none, RULES, root, "empty") and len(seen(spark, root)["messages"]) == 3
    assert batches.read(spark, str(tmp_path / "nowhere"), "messages", SCHEMA).collect() == []


def test_gathered_commits_replace_the_old_ones(spark, tmp_path):
    root = str(tmp_path / "out")
    for n in range(3):
        ingest.store_batch(spark.createDataFrame(rows(range(5 * n, 5 * n + 5)), SCHEMA), RULES, root, f"b-{n}")
    before = seen(spark, root)
    assert batches.gather(spark, root, "gathered-1", list(ingest.TABLES), "day")
    assert seen(spark, root) == before and batches.commits(spark, root).count() == 1
    assert len(batches.abandoned(spark, root, "messages")) == 3
    plan = batches.read(spark, root, "messages").where("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan

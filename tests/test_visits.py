"""Visits by timers, and what one round takes of those that are due."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from parapet.streaming import ingest, visits


@pytest.fixture
def store(spark):
    before = spark.conf.get(visits.STATE_STORE[0])
    spark.conf.set(*visits.STATE_STORE)
    yield
    spark.conf.set(visits.STATE_STORE[0], before)


def test_each_link_is_visited_so_often_and_forgotten(spark, tmp_path, store):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string").coalesce(1).write.parquet(source)
    stream = visits.link_visits(spark.readStream.schema("url string").parquet(source), first_ms=1500, every_ms=1000, attempts=3, keep_ms=600_000)
    q = stream.writeStream.outputMode("update").format("memory").queryName("visits").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("visits").count() < 6 and not q.exception():
            time.sleep(1)
        time.sleep(3)
        got = [tuple(r) for r in spark.table("visits").orderBy("due_ms").collect()]
    finally:
        q.stop()
    assert sorted(x[:2] for x in got) == [(u, n) for u in "ab" for n in (1, 2, 3)]
    for u in "ab":
        due = [x[2] for x in got if x[0] == u]
        assert due == sorted(due) and all(b - a >= 1000 for a, b in zip(due, due[1:]))  # noqa: B905


def test_a_round_takes_the_longest_due(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{i:03}", start + dt.timedelta(minutes=i), 0, None) for i in range(60)] + [("done", start, 4, start), ("again", start, 2, start - dt.timedelta(hours=7)), ("later", start, 1, start)]
    watches = spark.createDataFrame(rows, "url string, added_at timestamp, attempts int, last_at timestamp")
    now = F.lit(start + dt.timedelta(minutes=75))
    all_ = [r.url for r in ingest.due_visits(watches, now, None).orderBy("due", "url").collect()]
    assert all_ == ["again", *[f"u{i:03}" for i in range(46)]]
    first = ingest.due_visits(watches, now)
    assert [r.url for r in first.collect()] == all_[:25]
    claims = first.select("url", "attempt")
    assert [r.url for r in ingest.due_visits(watches, now, claims=claims).collect()] == all_[25:]

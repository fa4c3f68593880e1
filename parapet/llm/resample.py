"""Importance resampling towards a target distribution, over hashed word n-grams.

1. Long texts are cut into chunks at word boundaries. A chunk owns the positions at which its own words start and carries the next n - 1
   words along, so each n-gram of a text is counted in exactly one chunk. Chunks are dealt out over the cluster, so that no task holds
   more than a few of a very long text; texts of one chunk stay where they are read.
2. Features of all texts, and of the target texts, are counted by bucket: each task adds up its own counts, of which it sends one row for
   each bucket at most. The two histograms give each bucket's gain, a table whose size is a parameter.
3. Each chunk's features and gains are summed, then those of a text's chunks.
4. A text's weight is the mean gain of its features; Gumbel noise from a digest of its id makes the score. The highest scores are drawn;
   ranks come from a running count over range partitions.

A null text has no words, hence no features and weight 0, and is never drawn. A null doc_id counts as the word `null` where noise is drawn.
Repeated rows are texts of their own, each with its rank (in any order between equal rows). Without documents there are no rows; without
target texts gains still follow the formula. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import running_total, stored

CHUNK = 1 << 16  # bytes of a chunk, up to the end of its last word

_letters = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: A-Z becomes a-z; what is no letter of a word becomes a space.
FOLDED = bytes(b if b in _letters else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
NEXT_WORD = re.compile(rb" *[^ ]+")


def chunks_of(data: bytes, longest: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(words of a chunk and the next longest - 1, number of its own) of a folded text."""
    at = 0
    while True:
        end = data.find(b" ", at + size)
        if end < 0 or not data[end:].strip(b" "):
            yield data[at:], len(data[at:].split())
            return
        stop = end
        for _ in range(longest - 1):
            if (m := NEXT_WORD.match(data, stop)) is None:
                break
            stop = m.end()
        yield data[at:stop], len(data[at:end].split())
        at = end


def buckets_of(words: list[bytes], own: int, longest: int, n_buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to `longest` words that start at one of the first `own` words."""
    codes = [zlib.crc32(w) for w in words]
    out = codes[:own]
    for n in range(2, longest + 1):
        codes = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(codes, words[n - 1 :])]  # noqa: B905  one start less each time
        out += codes[:own]
    return np.array(out, np.int64) % n_buckets


def pieces(docs: DataFrame, text: str, longest: int) -> list[DataFrame]:
    """Texts of one chunk as they are, and the chunks of the others (folded): row, doc_id, words, own; row and own are null for whole texts."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for doc_id, x in zip(b.column(0), b.column(1), strict=True):
                for words, own in chunks_of(x.as_py().encode().translate(FOLDED), longest):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([doc_id.as_py()], pa.int64()), pa.array([words], pa.binary()), pa.array([own], pa.int64())], names=["row", "doc_id", "words", "own"])
                row += 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > CHUNK
    cut = plain.where(is_long).mapInArrow(chunked, "row long, doc_id long, words binary, own long").withColumn("part", F.monotonically_increasing_id()).repartition("part").drop("part")
    none = F.lit(None).cast("long")
    return [plain.where(~is_long).select(none.alias("row"), "doc_id", F.col("text").alias("words"), none.alias("own")), stored(cut, "chunks")]


def _found(b: pa.RecordBatch, longest: int, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Own words and the buckets of their features, a text or chunk at a time."""
    for words, own in zip(b.column(2), b.column(3), strict=True):
        words, own = words.as_py() or "", own.as_py()
        words = (words if own is not None else words.encode().translate(FOLDED)).split()
        own = len(words) if own is None else own
        yield own, buckets_of(words, own, longest, n_buckets)


def histogram(tables: list[DataFrame], longest: int, n_buckets: int) -> np.ndarray:
    """How many features fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for _, x in _found(b, longest, n_buckets):
                total += np.bincount(x, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = reduce(DataFrame.unionByName, [t.mapInArrow(count, "bucket long, n long") for t in tables])
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():  # n_buckets rows at most
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier a bucket is in the target, both smoothed by one in each bucket."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, target: DataFrame, longest: int = 2, n_buckets: int = 10_000) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight. `target` has a column text."""
    tables = pieces(docs, "text", longest)
    goal = pieces(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "text", longest)
    gains = gains_of(histogram(tables, longest, n_buckets), histogram(goal, longest, n_buckets))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [(own, len(x), int(gains[x].sum())) for own, x in _found(b, longest, n_buckets)]
            sums = [pa.array([x[i] for x in n], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sums], names=["row", "doc_id", "n_words", "n_features", "gain"])

    whole, cut = (t.mapInArrow(add, "row long, doc_id long, n_words long, n_features long, gain long") for t in tables)
    whole = whole.drop("row")
    cut = cut.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]).drop("row")
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return whole.unionByName(cut).select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = 25, least_words: int = 20, longest: int = 2, n_buckets: int = 10_000) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (1, 2, 3... of those drawn, else null)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(docs, target, longest, n_buckets).withColumn("score", (F.col("weight") + noise).cast("long"))
    scores = stored(scored.withColumns({"row": F.monotonically_increasing_id(), "one": F.lit(1).cast("long"), "down": -F.col("score")}), "scores")
    able = F.col("n_words") >= least_words
    drawn = percent * scores.where(able).count() // 100
    ranked = running_total(scores.where(able), ["down", "doc_id", "row"], "one", "before", "ranked")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("before") < drawn, F.col("before") + 1).alias("rank")
    return ranked.select(*columns, rank).unionByName(scores.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))

"""Helpers shared by the text operators: stored intermediate tables, running totals, word codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.sources.shared import read_table, shared_dir, stored  # noqa: F401


def running_total(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows that come earlier in the global order of `order`.

    `order` should be unique for each row; then a key shared by many rows is still cut by the range partitioning. Each range
    partition sums its own rows; only one total for each partition is added up elsewhere.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(ends - v)], names=[*b.schema.names, "_part", "_before"])
            total = int(ends[-1])

    table = stored(ranged.mapInArrow(sums, schema), name)
    parts = sorted(table.groupBy("_part").agg(F.sum(value).alias("n")).collect())  # a row for each partition
    offsets, at = [], 0
    for part, n in parts:
        offsets.append((part, at))
        at += n or 0
    small = df.sparkSession.createDataFrame(offsets, "_part int, _at long")
    return table.join(F.broadcast(small), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of counts (best stored) with the largest values of `n`, at most `most`: all from a limit on, which steps by a twelfth of a
    doubling. The limit comes from a histogram of some hundred bars, so that no task has to sort what all others found."""
    step = F.floor(F.log2(n) * 12)
    limit, rows = None, 0
    for bar, count in sorted(counts.groupBy(step.alias("bar")).count().collect(), reverse=True):
        rows += count
        if rows > most:
            break
        limit = bar
    return counts.where(F.lit(False) if limit is None else step >= limit)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores before it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: what a task makes of them, in Python objects, is held for so many texts only."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def let(value, body: Callable):
    """Bind a value once for use inside higher-order functions (an outer expression named in a lambda is evaluated again for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (an invertible finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


BLANKS = np.zeros(256, bool)
BLANKS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LETTER, BASE = mix(np.arange(1, 257)), 0x9E3779B97F4A7C15
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers


def word_codes(data: bytes) -> np.ndarray:
    """64-bit codes of the words of a text (runs of bytes other than white space), by a polynomial in each word's letters."""
    if len(data) > 2 * BLOCK:  # very long texts: in blocks that end at white space
        out, at = [], 0
        while at < len(data):
            end = at + BLOCK
            while end < len(data) and not BLANKS[data[end]]:
                end += 1
            out.append(_block_codes(data[at:end]))
            at = end
        return np.concatenate(out)
    return _block_codes(data)


def _block_codes(data: bytes) -> np.ndarray:
    letters = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANKS[letters], [True]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(LETTER[letters] * power[: len(letters)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def marked_bits(df: DataFrame, column: str, bits: int):
    """Broadcast bitmap of 2**bits bits with those of the column's values (their low bits) set; its size doesn't depend on the data."""
    place = F.expr(f"(`{column}` & {(1 << bits) - 1}L) + 1")  # the bitmap functions count from 1
    slices = df.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, found in slices.collect():  # of bounded size
        at = (bucket - 1) << 12
        out[at : at + len(found)] = np.frombuffer(found, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def is_marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & (8 * len(bitmap) - 1)
    return bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n consecutive words."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out)

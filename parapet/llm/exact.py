"""Exact dedup by a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
largest doc_id stays (a null doc_id is smaller than any other; among rows that share text and doc_id, all are marked alike).

The work runs in two levels. Each task indexes its own rows, so that a text with a third of all rows leaves a task as one row;
these rows are dealt out by digest and each shard indexes them again, in order of their digests and at most `MOST_LIVE` at a time. An index takes a row as follows: a fingerprint hit in the
cuckoo filter is verified against the full digest and length kept in the bucket; if it is a copy, the digest of the row that
loses is deleted and that of the new live row is inserted; a full table is doubled and refilled from the stored keys. A stored index is
kept up with `changed_groups`, which deletes the digests whose last document was removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import free_name, stored, texts_of

SLOTS, MOST_MOVES = 4, 64


class CuckooIndex:
    """Cuckoo filter over keys (bytes) whose buckets keep the key and a value behind each fingerprint."""

    def __init__(self, buckets: int = 1024):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]  # fingerprints: the filter
        self.kept = [[] for _ in range(buckets)]  # (key, value): the bucketed content
        self.size = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") | 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def _find(self, key: bytes) -> tuple[int, int] | None:
        mark, first, second = self._place(key)
        for b in (first, second):
            if mark in self.prints[b]:  # a hit in the filter, to be verified
                for i, (stored_key, _) in enumerate(self.kept[b]):
                    if stored_key == key:
                        return b, i
        return None

    def get(self, key: bytes):
        at = self._find(key)
        return None if at is None else self.kept[at[0]][at[1]][1]

    def delete(self, key: bytes) -> bool:
        at = self._find(key)
        if at is None:
            return False
        for rows in (self.prints, self.kept):
            rows[at[0]].pop(at[1])
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        mark, first, second = self._place(key)
        at = first if len(self.prints[first]) <= len(self.prints[second]) else second
        for move in range(MOST_MOVES):
            if len(self.prints[at]) < SLOTS:
                self.prints[at].append(mark)
                self.kept[at].append((key, value))
                self.size += 1
                return
            i = move % SLOTS  # evict one to its other bucket
            mark, self.prints[at][i] = self.prints[at][i], mark
            (key, value), self.kept[at][i] = self.kept[at][i], (key, value)
            at ^= mark * 0x5BD1E995 & self.mask
        self._grow()
        self.insert(key, value)

    def _grow(self) -> None:
        rows = list(self.items())
        self._empty(2 * (self.mask + 1))
        for key, value in rows:
            self.insert(key, value)

    def items(self) -> Iterator[tuple[bytes, object]]:
        for rows in self.kept:
            yield from rows


MOST_LIVE = 500_000  # digests in one index: some 200 MB
DIGESTS = "doc_id long, text_sha256 string, n_bytes long, row_key long"
ROWS = "text_sha256 string, n_bytes long, keep_id long, group_size long"


def _live(index: CuckooIndex, key: bytes, size: int, doc, count: int) -> None:
    found = index.get(key)
    if found is None:
        index.insert(key, (size, doc, count))
        return
    if found[0] != size:
        raise ValueError("two texts of different lengths share a digest")
    best = doc if found[1] is None or (doc is not None and doc > found[1]) else found[1]
    index.delete(key)
    index.insert(key, (size, best, found[2] + count))


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k, _ in part], pa.string()), *(pa.array([v[j] for _, v in part], pa.int64()) for j in range(3))], names=["text_sha256", "n_bytes", "keep_id", "group_size"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lowered = [x.encode().lower() for x in texts_of(b.column(1))]  # bytes.lower changes A-Z only
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in lowered], pa.string()), pa.array([len(x) for x in lowered], pa.int64()), b.column(2)], names=["doc_id", "text_sha256", "n_bytes", "row_key"])


def _own_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for doc, sha, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            _live(index, bytes.fromhex(sha), size, doc, 1)
        if index.size >= MOST_LIVE:  # bounded memory: pass on what is known so far
            yield from _rows(index)
            index = CuckooIndex()
    yield from _rows(index)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by digest: what is indexed is passed on whenever the index is full and the next digest is another, so memory is bounded."""
    index, last = CuckooIndex(), None
    for b in batches:
        for sha, size, doc, count in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if index.size >= MOST_LIVE and sha != last:
                yield from _rows(index)
                index = CuckooIndex()
            _live(index, bytes.fromhex(sha), size, doc, count)
            last = sha
    yield from _rows(index)


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_sha256, n_bytes, keep_id, group_size, change) by digest, stored ones first: insertions and deletions of live digests."""
    index, last = CuckooIndex(), None
    for b in batches:
        for sha, size, doc, count, change in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if index.size >= MOST_LIVE and sha != last:
                yield from _rows(index)
                index = CuckooIndex()
            key, last = bytes.fromhex(sha), sha
            if change >= 0:
                _live(index, key, size, doc, count)
            elif (found := index.get(key)) is not None:
                index.delete(key)
                if found[2] > count:  # texts are left; which one stays is told by the rows that remain
                    index.insert(key, (found[0], found[1], found[2] - count))
    yield from _rows(index)


def changed_groups(groups: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Upkeep of a stored index: groups (as `group_table` gives them) after the documents of `added` came and those of `removed` went.

    A digest whose last document goes is deleted from the filter and has no row any more. `keep_id` of a group that lost documents stays
    what it was; where the row that stayed was removed itself, take `group_table` of what is left."""
    new = group_table(added).withColumn("change", F.lit(1))
    gone = group_table(removed).withColumn("change", F.lit(-1))
    rows = groups.withColumn("change", F.lit(0)).unionByName(new).unionByName(gone).withColumn("last", F.col("change") < 0)
    ordered = rows.repartition("text_sha256").sortWithinPartitions("text_sha256", "last").drop("last")
    return ordered.mapInArrow(_change, ROWS)


def group_table(docs: DataFrame) -> DataFrame:
    """The live digests of docs: text_sha256, n_bytes, keep_id, group_size."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), row_key(docs).alias("row_key"))
    return _grouped(plain.mapInArrow(_digests, DIGESTS))


def _grouped(marks: DataFrame) -> DataFrame:
    own = marks.drop("row_key").mapInArrow(_own_copies, ROWS)
    return own.repartition(F.col("text_sha256")).sortWithinPartitions("text_sha256").mapInArrow(_shard, ROWS)


def row_key(docs: DataFrame):
    """The same for rows alike in doc_id and text, null or not."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, any more columns): doc_id, keep_id, group_size, kept, text_sha256, row_key. An empty table gives no rows."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), row_key(docs).alias("row_key"))
    marks = stored(plain.mapInArrow(_digests, DIGESTS), "digests")
    return marks.select("doc_id", "text_sha256", "row_key").join(_grouped(marks).drop("n_bytes"), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row_key")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that lose; of rows alike in doc_id and text one stays. Columns stay as they are."""
    name = free_name(docs, "row_key")
    kept = exact_groups(docs).where("kept").select(F.col("row_key").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key(docs)).join(kept, name, "left_semi")
    return keyed.dropDuplicates([name, "doc_id", "text"]).select(docs.columns)

"""Packing by cutting-stock column generation.

1. Texts are tokenised once; the table keeps lengths and checksums, and ids only for texts longer than a sequence.
2. The driver sees the histogram of lengths, which has at most `length` bars whatever the corpus. Lengths are grouped into at most
   `CLASSES` classes, where that rounds up the fewest tokens, and a linear program over patterns (how many texts of each class share a
   sequence) is solved by column generation. Its first columns come from filling sequences largest first. Then a knapsack dynamic
   program prices new patterns at smoothed dual prices; each pass also gives a lower bound (the tokens alone are the first one). It
   ends when the program is within `GAP` of the bound, or no pattern improves it; there is no limit on rounds.
3. Patterns are rounded down; what is left of the histogram is filled largest first. Documents are ranked by (class, row) over the
   whole cluster, and a rank names its pattern, its copy of the pattern and so its sequence.
4. Texts longer than a sequence form one tape in row order. The tape fills what the patterns leave free, from `least` tokens on,
   and goes on in full sequences. Only these texts are cut.

Null texts are empty and pack as their end token alone. Repeated rows and repeated doc_ids are packed each on their own; a null
doc_id is kept. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import running_total, stored, texts_of
from parapet.llm.tokens import piece_ids

CELL = 1 << 17  # tape tokens in a cell of the overlap join
CLASSES, GAP = 192, 1 / 500


def class_sizes(bars: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The largest length of each class. bars: how many texts have each length. Of the lengths that occur, neighbours are merged while there
    are more than `most`, always the two whose merging rounds up the fewest tokens."""
    size = np.flatnonzero(bars).tolist()
    weight, last = [int(bars[x]) for x in size], len(size) - 1
    after, before, alive = list(range(1, last + 2)), list(range(-1, last)), [True] * (last + 1)
    costs = [(weight[i] * (size[i + 1] - size[i]), i, i + 1, weight[i]) for i in range(last)]
    heapq.heapify(costs)
    left = len(size)
    while left > most:
        _, i, j, w = heapq.heappop(costs)
        if not (alive[i] and alive[j]) or after[i] != j or weight[i] != w:
            continue  # of a pair that has changed since
        alive[i], weight[j], left, before[j] = False, weight[j] + w, left - 1, before[i]
        if (p := before[i]) >= 0:
            after[p] = j
            heapq.heappush(costs, (weight[p] * (size[j] - size[p]), p, j, weight[p]))
        if (n := after[j]) <= last:
            heapq.heappush(costs, (weight[j] * (size[n] - size[j]), j, n, weight[j]))
    return np.array([x for x, a in zip(size, alive, strict=True) if a], np.int64)


def best_patterns(sizes: np.ndarray, prices: np.ndarray, length: int, least: float, most: int) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack by dynamic programming over the capacity; multiples of a class enter by powers of two. The value of the best
    pattern, and the best patterns that hold given classes, as far as they are worth more than `least`."""
    best, taken, steps = np.zeros(length + 1), [], []
    for c in np.flatnonzero(prices > 1e-12).tolist():
        w, worth = int(sizes[c]), float(prices[c])
        times = 1
        while w <= length:
            more = best[: length + 1 - w] + worth
            better = more > best[w:] + 1e-12
            np.copyto(best[w:], more, where=better)
            taken.append(better)
            steps.append((c, times, w))
            w, worth, times = 2 * w, 2 * worth, 2 * times
    holding = best[length - sizes] + prices
    found = {}
    for c in np.argsort(-holding)[:most].tolist():
        if holding[c] <= least:
            break
        counts, at = [0] * len(sizes), length - int(sizes[c])
        counts[c] = 1
        for (k, times, w), better in zip(reversed(steps), reversed(taken), strict=True):
            if at >= w and better[at - w]:
                counts[k] += times
                at -= w
        found[tuple(counts)] = None
    return best[length], [np.array(x, np.int64) for x in found]


def inverted(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination in plain array steps: the driver's process has threads enough, so no linear-algebra library is called."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], 1)
    for i in range(m):
        p = i + int(np.abs(work[i:, i]).argmax())
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, m:]


def filled(size: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(copies, counts by class): sequences filled largest first, until nothing is left."""
    left, out = left.copy(), []
    while left.any():
        room, col = length, np.zeros(len(size), np.int64)
        for c in np.flatnonzero(left)[::-1].tolist():
            col[c] = min(int(left[c]), room // int(size[c]))
            room -= int(col[c] * size[c])
        held = col > 0
        copies = int((left[held] // col[held]).min())
        left -= copies * col
        out.append((copies, col))
    return out


class Program:
    """The linear program in its basis: as many patterns as classes, and how often each is used. Sums are plain array steps: the driver's
    process has threads enough, so no linear-algebra library is called."""

    def __init__(self, size: np.ndarray, need: np.ndarray, length: int) -> None:
        self.need = need * (1 + 1e-7 * np.modf(np.arange(1, len(need) + 1) * 0.618034)[0])  # no two ratios tie, so pivots don't go in circles
        self.columns = np.diag(length // size).astype(float)
        self.inverse, self.x = np.diag(1 / np.diag(self.columns)), self.need / np.diag(self.columns)
        self.pool = np.array([c for _, c in filled(size, need, length)])
        self.turns = 0

    def prices(self) -> np.ndarray:
        return self.inverse.sum(0)

    def descend(self) -> None:
        """Patterns of the pool enter the basis while they lower the objective."""
        while len(self.pool):
            worth = (self.pool * self.prices()).sum(1)
            k = int(worth.argmax())
            if worth[k] <= 1 + 1e-7:
                return
            d = (self.inverse * self.pool[k]).sum(1)
            ratio = np.where(d > 1e-9, self.x / np.where(d > 1e-9, d, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                self.pool = np.delete(self.pool, k, 0)
                continue
            self.columns[:, out] = self.pool[k]
            self.turns += 1
            if self.turns % 100 == 0:  # afresh, against rounding
                self.inverse = inverted(self.columns)
                self.x = (self.inverse * self.need).sum(1)
            else:
                step, row = ratio[out], self.inverse[out] / d[out]
                self.x = self.x - step * d
                self.x[out] = step
                self.inverse = self.inverse - d[:, None] * row
                self.inverse[out] = row
            self.x = np.maximum(self.x, 0)


def solved(size: np.ndarray, need: np.ndarray, length: int, gap: float) -> tuple[Program, float]:
    """The program within `gap` of a lower bound, and that bound. Prices that fit every pattern bound it from below; new patterns are sought
    at prices between the basis' own and those of the best bound so far, nearer to its own where that finds none."""
    program = Program(size, need, length)
    centre = size / length  # no pattern is worth more than 1 at these
    bound, share = float((need * centre).sum()), 0.9
    while True:
        program.descend()
        if program.x.sum() <= (1 + gap) * bound:
            return program, bound
        own, new = np.maximum(program.prices(), 0), []
        while not new:
            mixed = share * centre + (1 - share) * own
            value, found = best_patterns(size, mixed, length, 0.0, 48)
            if (low := float((need * mixed).sum()) / value) > bound:
                bound, centre = low, mixed / value
            new = [x for x in found if (x * own).sum() > 1 + 1e-6]
            if not new and share == 0:
                return program, bound  # no pattern improves it
            share = share if new else 0 if share < 0.2 else share - 0.3
        program.pool = np.concatenate([program.pool, np.array(new)])
        if len(program.pool) > 3000:
            program.pool = program.pool[np.argsort(-(program.pool * own).sum(1))[:2000]]


def patterns_of(sizes: np.ndarray, demand: np.ndarray, length: int, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """(copies, counts by class) that hold exactly the demand: the program's patterns rounded down, and what is left filled largest first."""
    if not len(sizes):
        return []
    program, _ = solved(sizes, demand, length, gap)
    plan, left = [], demand.copy()
    for j in np.argsort(-program.x, kind="stable"):
        col = program.columns[:, j].astype(np.int64)
        held = col > 0
        copies = min(int(program.x[j] + 1e-3), int((left[held] // col[held]).min()))
        if copies:
            left -= copies * col
            plan.append((copies, col))
    return plan + filled(sizes, left, length)


@dataclass
class Slots:
    """For each stretch of ranks: from where on, documents of it in a sequence, first sequence."""

    start: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    sequences: int


def slots_of(plan: list[tuple[int, np.ndarray]], demand: np.ndarray) -> Slots:
    at = np.concatenate([[0], np.cumsum(demand)[:-1]])
    rows, sequence = [], 0
    for copies, counts in plan:
        for c in np.flatnonzero(counts):
            rows.append((at[c], counts[c], sequence))
            at[c] += copies * counts[c]
        sequence += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return Slots(table[:, 0], table[:, 1], table[:, 2], sequence)


def token_table(docs: DataFrame, json_path: str, ranks_path: str, end_id: int, length: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, row = piece_ids(json_path, ranks_path), TaskContext.get().partitionId() << 36
        for b in batches:
            crc, n, ids = [], [], []
            for text in texts_of(b.column(1)):
                x = ids_of(text) + end
                crc.append(zlib.crc32(x))
                n.append(len(x) // 4)
                ids.append(x if n[-1] > length else None)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(n)), pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "doc_tokens", "ids_crc32", "ids"])
            row += len(n)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(plain.mapInArrow(encode, "row long, doc_id long, doc_tokens long, ids_crc32 long, ids binary"), "tokens")


def pack(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 1, length: int = 2048, least: int = 16) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = token_table(docs, json_path, ranks_path, end_id, length)
    bars = np.zeros(length + 1, np.int64)
    for n, count in tokens.where(F.col("doc_tokens") <= length).groupBy("doc_tokens").count().collect():  # at most `length` rows
        bars[n] = count
    sizes = class_sizes(bars)
    demand = np.zeros(len(sizes), np.int64)
    np.add.at(demand, np.searchsorted(sizes, np.flatnonzero(bars)), bars[bars > 0])
    slots = slots_of(patterns_of(sizes, demand, length), demand)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            i = np.searchsorted(slots.start, rank, "right") - 1
            where = slots.sequence[i] + (rank - slots.start[i]) // slots.each[i] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in ("doc_id", "doc_tokens", "ids_crc32", "rank")] + [pa.array(where, pa.int64())], names=["doc_id", "doc_tokens", "ids_crc32", "rank", "sequence_id"])

    def classes(n: pa.Array) -> np.ndarray:
        return np.searchsorted(sizes, n.to_numpy())

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(classes(b.column(2)), pa.int64()), pa.array(np.ones(b.num_rows, np.int64))], names=["row", "doc_id", "doc_tokens", "ids_crc32", "class", "one"])

    short = tokens.where(F.col("doc_tokens") <= length).drop("ids").mapInArrow(classed, "row long, doc_id long, doc_tokens long, ids_crc32 long, class long, one long")
    ranked = running_total(short, ["class", "row"], "one", "rank", "ranked")
    inside = F.expr("sum(doc_tokens) over (partition by sequence_id order by rank) - doc_tokens")
    placed = stored(ranked.mapInArrow(place, "doc_id long, doc_tokens long, ids_crc32 long, rank long, sequence_id long").withColumn("offset", inside), "placed")
    whole = placed.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("doc_tokens").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    long_texts = tokens.where(F.col("doc_tokens") > length)
    if long_texts.isEmpty():
        return whole

    tape = running_total(long_texts.select("row", "doc_tokens"), ["row"], "doc_tokens", "t0", "tape")
    used = placed.groupBy("sequence_id").agg(F.sum("doc_tokens").alias("used")).withColumn("room", length - F.col("used"))
    used = used.where((F.col("room") >= least) & (F.expr("used & (used - 1)") != 0))
    room = running_total(used, ["sequence_id"], "room", "r0", "room").withColumn("r1", F.col("r0") + F.col("room"))
    filled = room.agg(F.coalesce(F.max("r1"), F.lit(0))).first()[0]  # tape position from which full sequences follow
    tape = tape.withColumn("t1", F.col("t0") + F.col("doc_tokens"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL))).alias("cell")
    lo, hi = F.greatest("t0", "r0"), F.least("t1", "r1")
    cut = tape.where(F.col("t0") < filled).select("*", cells("t0", "t1")).join(room.select("*", cells("r0", "r1")), "cell").where((lo < hi) & (F.floor(lo / CELL) == F.col("cell")))
    cut = cut.select("row", (lo - F.col("t0")).alias("start"), (hi - lo).alias("length"), "sequence_id", (F.col("used") + lo - F.col("r0")).alias("offset"))
    k = F.col("k")
    rest = tape.where(F.col("t1") > filled).select("*", F.explode(F.sequence(F.floor((F.greatest("t0", F.lit(filled)) - filled) / length), F.floor((F.col("t1") - 1 - filled) / length))).alias("k"))
    lo, hi = F.greatest(F.col("t0"), filled + k * length), F.least(F.col("t1"), filled + (k + 1) * length)
    rest = rest.select("row", (lo - F.col("t0")).alias("start"), (hi - lo).alias("length"), (slots.sequences + k).alias("sequence_id"), (lo - filled - k * length).alias("offset"))
    pieces = cut.unionByName(rest).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # no longer than the text

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            for doc, n, ids, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows = [(doc, p["start"], p["length"], zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]), n, p["sequence_id"], p["offset"]) for p in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    parts = long_texts.join(pieces, "row").select("doc_id", "doc_tokens", "ids", "pieces")
    return whole.unionByName(parts.mapInArrow(checksums, whole.schema))


def production(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

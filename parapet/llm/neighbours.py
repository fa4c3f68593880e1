"""Approximate nearest neighbours by collision counting over single projections.

1. Vectors that take part are brought to length one and get a row number; they are dealt by it into shards of bounded size, whatever
   their ids and values. Queries are dealt into parts of bounded size, and each part meets each shard in a group of its own.
2. A shard's index has one array for each of `projections` random directions: its vectors' places, sorted by their values there.
3. A query asks the `asked` arrays in which its own value lies farthest out, where few vectors are and a collision tells most. Its window
   in one reaches from the end on its side down to c times its value: half of the vectors at cosine c from it lie there, fewer of those
   farther off. Windows grow as c falls (virtual rehashing: nothing is hashed again, the same arrays are read further in), and each
   vector's collisions are counted as windows reach it.
4. Vectors with more collisions than all but a small share of those at cosine c would fall short of are verified by their cosine (in single
   precision first, where that rules them out). c starts where k neighbours of the shard's own rows usually are and falls until it reaches
   the k-th best verified, or 0, when all that is left is verified.
5. Queries meet an eighth of the shards first. The k-th best that a query found there bounds c in the others: they start at it and end there,
   so windows are smaller the larger the table is.
6. The k best of all shards are merged for each query.

There is no cap on windows, candidates or partners. Vectors that are null, zero, or hold null or non-finite components take no part.
A query is only compared with vectors of its own length. Rows with a null vec_id can be found, but don't ask. Repeated rows and ids are
rows of their own: each may ask, and finds the others. Ties go to the smaller vec_id, null last. An empty table gives no rows; where there are fewer
candidates than k, all are found. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import stored

SHARD, PART = 16384, 8192  # vectors and queries that meet in a group
FIRST, FEW = 8, 4  # one in so many shards is met first; all at once, if there are fewer shards
STEP = 0.02  # how much c falls first; each step is twice the one before
GRID, FAR = 32, 8  # window ends are looked up at so many points a unit of value, up to so far out; a window ends at the next point beyond
SLACK = 1e-3  # cosines in single precision are off by far less; what they leave is verified in double
TRIED = 64  # rows of a shard whose k-th neighbours say where c starts


class Index:
    """A shard's unit vectors sorted along random directions."""

    def __init__(self, unit: np.ndarray, directions: np.ndarray, asked: int, miss: float, k: int) -> None:
        self.unit, self.rough, self.n = unit, unit.astype(np.float32), len(unit)
        m = directions.shape[1]
        self.asked = min(asked, m)
        self.least = max(1, ceil(self.asked / 2 - miss * sqrt(self.asked) / 2))
        self.places, self.below = np.empty((m, self.n), np.int32), np.empty((m, 2 * FAR * GRID + 1), np.int32)
        points = np.arange(-FAR * GRID, FAR * GRID + 1) / GRID
        for i in range(0, m, 64):
            for j, values in enumerate(directions[:, i : i + 64].T @ unit.T, i):
                self.places[j] = order = np.argsort(values)
                self.below[j] = np.searchsorted(values[order], points)
        near = unit[:: -(-self.n // TRIED)] @ unit.T
        self.start = float(np.median(np.partition(near, -min(k + 1, self.n), axis=1)[:, -min(k + 1, self.n)]))  # k and the row itself

    def nearest(self, query: np.ndarray, values: np.ndarray, own: int, k: int, bound: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest found, in no order; more where the k-th is tied. values: the query's in all arrays; `own`: its own place here, or -1; bound: only cosines from there on are wanted."""
        far = np.abs(values)
        arrays = np.argpartition(far, -self.asked)[-self.asked :]
        far, upper = far[arrays] * GRID, values[arrays] > 0
        reached = np.where(upper, self.n, 0)
        counts, seen = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        seen[own : own + 1 if own >= 0 else own] = own >= 0
        found, cosines, brief = np.empty(0, np.int64), np.empty(0), query.astype(np.float32)
        c, step, wanted = self.start if bound is None else bound, STEP, min(k, self.n - (own >= 0))
        while wanted:
            whole = c <= 0
            if not whole:
                point = np.minimum((c * far).astype(np.int64), FAR * GRID)
                ends = self.below[arrays, FAR * GRID + np.where(upper, point, -point)]
                runs = zip(arrays.tolist(), np.where(upper, ends, reached).tolist(), np.where(upper, reached, ends).tolist(), strict=True)
                counts += np.bincount(np.concatenate([self.places[j, a:b] for j, a, b in runs]), minlength=self.n)
                reached = ends
            more = np.flatnonzero(~seen if whole else (counts >= self.least) & ~seen)
            if len(more):
                seen[more] = True
                rough = self.rough[more] @ brief
                least = -2.0 if bound is None else bound
                if len(found) >= wanted:
                    least = max(least, cosines.min())
                if len(more) > wanted:
                    least = max(least, np.partition(rough, -wanted)[-wanted])
                more = more[rough >= least - SLACK]
                found, cosines = np.concatenate([found, more]), np.concatenate([cosines, (self.unit[more] * query).sum(1)])
                if len(found) > wanted:
                    kth = np.partition(cosines, -wanted)[-wanted]
                    best = cosines >= kth - 1e-9
                    found, cosines = found[best], cosines[best]
            if whole or bound is not None or len(found) >= wanted and cosines.min() >= c:
                break
            c, step = max(c - step, cosines.min() if len(found) >= wanted else 0.0), 2 * step
        if bound is not None:
            found, cosines = found[cosines >= bound - 1e-9], cosines[cosines >= bound - 1e-9]
        return found, cosines


def search(vectors: DataFrame, asks: str = "vec_id % 50 = 0", k: int = 5, projections: int = 1024, asked: int = 40, miss: float = 2.8, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row for which `asks` holds. vectors: vec_id, embedding."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = [(row + i, v, bool(a), x) for i, (v, a, x) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)) if x and None not in x and np.isfinite(x).all() and any(x)]
            row += b.num_rows
            data = [np.array(x[3], np.float64) for x in rows]
            data = [x / np.abs(x).max() for x in data]  # else the squares of very large or small numbers are lost
            unit = [(x / sqrt((x * x).sum())).tobytes() for x in data]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.bool_()), pa.array([len(x) for x in data], pa.int32()), pa.array(unit, pa.binary())],
                names=["row", "vec_id", "asks", "dim", "unit"],
            )

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"coalesce({asks}, false) and vec_id is not null").alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
    table = stored(plain.mapInArrow(prepared, "row long, vec_id long, asks boolean, dim int, unit binary"), "vectors")
    n, asking = table.agg(F.count("*"), F.count_if("asks")).first()
    shards, parts = max(1, -(-n // SHARD)), max(1, -(-asking // PART))
    hashed = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    held = table.select("dim", hashed(shards).alias("shard"), each(0, parts).alias("part"), "row", "vec_id", "unit")
    queries = table.where("asks").select("dim", hashed(parts).alias("part"), "row", "vec_id", "unit")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            left, right = left.sort_by("row"), right.sort_by("row")  # rows come in any order
            matrix = lambda t: np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, dim)
            ids, place = left.column("vec_id").to_pylist(), {r: i for i, r in enumerate(left.column("row").to_pylist())}
            directions = np.random.default_rng(seed).standard_normal((dim, projections))
            index, asking = Index(matrix(left), directions, asked, miss, k), matrix(right)
            for row, query_id, bound, q, values in zip(*(right.column(c).to_pylist() for c in ("row", "vec_id", "bound")), asking, asking @ directions, strict=True):
                found, cosines = index.nearest(q, values, place.get(row, -1), k, bound)
                best = sorted(zip((-cosines).tolist(), [(ids[i] is None, ids[i] or 0) for i in found.tolist()], strict=True))[:k]
                out += [(row, query_id, None if null else v, -score) for score, (null, v) in best]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row", "query_id", "vec_id", "score"])

    def met(asking: DataFrame, start: int, stop: int) -> DataFrame:
        """The k best that queries find in each of these shards."""
        key = ["dim", "shard", "part"]
        left = held.where(F.col("shard").between(start, stop - 1)).groupBy(*key)
        right = asking.select(*(F.col(c).alias(c) for c in asking.columns), each(start, stop).alias("shard")).groupBy(*key)  # columns of its own
        return left.cogroup(right).applyInArrow(near, "row long, query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.expr("row_number() over (partition by row order by score desc, vec_id asc nulls last)")).where(F.col("rank") <= k)

    first = shards if shards < FEW else -(-shards // FIRST)
    best = met(queries.withColumn("bound", F.lit(None).cast("double")), 0, first)
    if first < shards:
        top = stored(ranked(best).drop("rank"), "nearest")
        bounds = top.groupBy("row").agg(F.expr(f"case when count(*) >= {k} then min(score) end").alias("bound"))
        best = top.unionByName(met(queries.join(bounds, "row", "left"), first, shards))
    return ranked(best).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def production(vectors: DataFrame) -> DataFrame:
    return search(vectors)

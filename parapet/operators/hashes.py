"""64-bit hashes near known ones, exactly: by parts of the hash, with a few bits changed on the known side."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_code(vector: Column) -> Column:
    """The signs of a vector's first 64 components as a long; what isn't there counts as not positive."""
    bits = F.transform(F.slice(vector, F.lit(1), F.lit(64)), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    places = F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _parts(most: int, parts: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(first bit, bits) of each part, and the changes of up to most // parts bits in it: two hashes that differ in `most` bits differ in no more
    than that in one part at least."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    sizes = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sizes, [[sum(1 << i for i in chosen) for k in range(most // parts + 1) for chosen in combinations(range(n), k)] for _, n in sizes]


def near(hashes: DataFrame, known: DataFrame, most: int = 13, parts: int = 4) -> DataFrame:
    """id, known_id, distance: hashes(id, hash) that differ from known(known_id, hash) in at most `most` bits; every such pair once.

    Each known hash stands under all values that its parts can take within the allowed changes (697 for each part of 16 bits and three changed
    bits), each other hash under its own. They meet by equal part, in one equi-join, which sees some 4 % of all pairs; none is lost. The
    known side grows by these values, so it should be the smaller one.
    """
    sizes, changes = _parts(most, parts)
    cut = lambda h, a, n: F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << n) - 1))
    own = F.array(*[F.struct(F.lit(k).alias("part"), cut(F.col("hash"), a, n).alias("value")) for k, (a, n) in enumerate(sizes)])
    left = hashes.where("hash is not null").select("id", "hash", F.explode(own).alias("p")).select("id", "hash", "p.part", "p.value")
    masks = hashes.sparkSession.createDataFrame([(k, m) for k, row in enumerate(changes) for m in row], "part int, change long")  # some thousands, by `most` and `parts` alone
    right = known.where("hash is not null").select("known_id", F.col("hash").alias("known_hash"), F.explode(own).alias("p")).select("known_id", "known_hash", "p.part", F.col("p.value").alias("kept"))
    right = right.join(F.broadcast(masks), "part").select("known_id", "known_hash", "part", F.col("kept").bitwiseXOR(F.col("change")).alias("value"))
    distance = F.bit_count(F.col("hash").bitwiseXOR(F.col("known_hash")))
    met = left.join(right, ["part", "value"]).where(distance <= most)
    return met.select("id", "known_id", distance.cast("int").alias("distance")).distinct()

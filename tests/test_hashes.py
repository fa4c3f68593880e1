"""Hashes near known ones against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import hashes


@pytest.mark.parametrize(("most", "parts"), [(13, 4), (3, 4), (0, 2), (7, 3)])
def test_near_hashes_against_all_pairs(spark, most, parts):
    rng = random.Random(most)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    known = [rng.getrandbits(64) for _ in range(12)]
    rows = [rng.getrandbits(64) for _ in range(60)] + [k ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 18))) for k in known for _ in range(15)] + [known[0]]
    got = hashes.near(
        spark.createDataFrame([(i, signed(h)) for i, h in enumerate(rows)] + [(999, None)], "id long, hash long"), spark.createDataFrame([(i, signed(h)) for i, h in enumerate(known)], "known_id long, hash long"), most, parts
    )
    want = {(i, k, (a ^ b).bit_count()) for i, a in enumerate(rows) for k, b in enumerate(known) if (a ^ b).bit_count() <= most}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_sign_code(spark):
    vectors = [[1.0] * 64, [-1.0] * 63 + [2.0], [0.5, -1.0, 3.0], [], None, [1.0] * 70]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>")
    assert [r[0] for r in df.select(hashes.sign_code(F.col("v"))).collect()] == [-1, -(1 << 63), 5, 0, None, -1]

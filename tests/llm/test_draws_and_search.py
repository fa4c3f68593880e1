"""Importance resampling, fill-in-the-middle and nearest neighbours against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.llm import middle, neighbours, resample

SCHEMA = "doc_id long, text string, rank string, part int, weight double, unit string, n long"


def texts():
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta naïve 日本 x1 Epsilon".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [prose(rng.randint(1, 60)) for _ in range(60)]
    out += ["", " ", None, "\t\n ", "one", "  one  two ", "a<P>b", "x <S> y z", "<M>", "ab < P> c d e f", "end <", "🙂 🙂🙂 é", "don't-stop", "\x85 \x1c a\x0bb"]
    out += [prose(9000), "w" * 70_000 + " tail of it", "ab " * 22_000 + "w" * 70_000 + " " + "cd " * 30_000]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(None, out[0]), (3, out[3]), (3, out[3]), (3, out[4]), (None, None)]  # no id, repeated rows, a repeated id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, 0.5, "u", 7) for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def split(doc_id, text, percent):
    h = sha(f"42:{'null' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent", [50, 100])
def test_middle(docs, none, percent):
    want = Counter((i, *split(i, t or "", percent)) for i, t in texts())
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    made = middle.transform(docs, percent=percent)
    assert Counter(map(tuple, made.collect())) == want
    back = made.select("doc_id", middle.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in texts())
    assert middle.transform(none).collect() == []
    assert middle.report(none).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_middle_report_and_plan(docs):
    want = Counter((i, n, f, p, m, sha(out), sha(t or "")) for i, t in texts() for n, f, p, m, out in [split(i, t or "", 50)])
    made = middle.report(docs)
    assert Counter(map(tuple, made.collect())) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "EvalPython" not in final and "InArrow" not in final


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]  # noqa: B905


def test_resample(spark, docs, none):
    goal = [("alpha beta gamma delta",), (None,), ("x1 x1 x1 日本 " * 12_000,)]
    target = spark.createDataFrame(goal, "text string")
    rows = texts()
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x or "")[1])
    for (x,) in goal:
        t.update(features(x or "")[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10_000) / ((s[b] + 1.0) * (nt + 10_000)))) for b in {*s, *t}}
    scored = []
    for i, x in rows:
        w, f = features(x or "")
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'null' if i is None else i}")[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    got = resample.resample(docs, target).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in scored)
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert [(d, s) for _, d, s in drawn] == [(x[0], x[3]) for x in able[: 25 * len(able) // 100]] and [r for r, *_ in drawn] == list(range(1, len(drawn) + 1))
    assert resample.resample(none, target).collect() == []
    assert len(resample.resample(docs, target.limit(0)).collect()) == len(rows)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_chunks_own_every_start_once(size):
    rng = random.Random(size)
    for longest in (1, 2, 3):
        for _ in range(50):
            data = b"".join(rng.choice([b" ", b"  ", b"a", b"bc", b"defgh"]) for _ in range(rng.randint(0, 60)))
            whole = resample.buckets_of(data.split(), len(data.split()), longest, 1000)
            parts = [resample.buckets_of(w.split(), own, longest, 1000) for w, own in resample.chunks_of(data, longest, size)]
            assert Counter(np.concatenate(parts).tolist()) == Counter(whole.tolist())


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 16)).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[50]) for i in range(40)]  # a group of equal vectors, two of them queries
    rows += [(50, x[50]), (50, x[51]), (None, x[3]), (2000, None), (2050, []), (2100, [0.0] * 16), (2150, [None, *x[4][1:]]), (2200, [math.inf, *x[4][1:]]), (2250, [math.nan, *x[4][1:]])]
    rows += [(3000, [1e200] + [0.0] * 15), (3001, [1e-200] + [0.0] * 15), (4000, [1.0, 2.0]), (4001, [2.0, 4.1]), (4002, [-1.0, 0.5]), (4050, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("row", F.lit(0)).repartition(4)
    got = neighbours.search(table).collect()
    good = [(n, i, v) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    scale = lambda v: np.array(v) / np.abs(v).max()
    hits = wanted = 0
    seen = Counter()
    for n, i, v in good:
        if i is None or i % 50:
            continue
        near = sorted(((-round(cosine(scale(v), scale(w)), 12), j is None, j or 0) for m, j, w in good if m != n and len(w) == len(v)))[:5]
        seen[i] += len(near)
        wanted += len(near)
        hits += len({(None if null else j) for _, null, j in near} & {r.vec_id for r in got if r.query_id == i})
    assert Counter(r.query_id for r in got) == +seen
    assert hits / wanted >= 0.97
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert any(abs(r.score - cosine(scale(v), scale(w))) < 1e-9 for v in [v for _, i, v in good if i == r.query_id] for w in [w for _, j, w in good if j == r.vec_id])
    first = [x.vec_id for x in sorted(by[1000], key=lambda r: r["rank"])]
    assert first == [50, 50, 1001, 1002, 1003]  # ties to the smaller id
    assert neighbours.search(table.limit(0)).collect() == []


def test_neighbours_over_several_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 200)
    monkeypatch.setattr(neighbours, "PART", 10)
    x = np.random.default_rng(2).standard_normal((900, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, asks="vec_id % 20 = 0").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 20):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 225 and hits / 225 >= 0.95


def read_by(monkeypatch, nearest, asking):
    """What nearest() finds for each of `asking`, and how many array entries it reads at a time."""
    read, count = [], np.bincount
    monkeypatch.setattr(neighbours.np, "bincount", lambda x, *a, **b: read.append(len(x)) or count(x, *a, **b))
    out = [nearest(i) for i in asking]
    monkeypatch.undo()
    return out, read


def test_neighbours_read_a_small_part_of_the_arrays(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 64))
    x[6000:] = x[6000] + 1e-3 * rng.standard_normal((2000, 64))  # near ones, among which c starts too high for the others
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for rows, most in ((unit[:6000], 25), (unit, 30)):
        directions = np.random.default_rng(3).standard_normal((64, 512))
        index = neighbours.Index(rows, directions, 64, 2.4, 5)
        asking = range(0, len(rows), 97)
        found, read = read_by(monkeypatch, lambda i: index.nearest(rows[i], rows[i] @ directions, i, 5), asking)  # noqa: B023
        assert sum(read) <= most * len(asking) * len(rows)  # windows around the query's own value in 128 arrays: 76 and 66 for each query and vector
        hits = 0
        for i, (places, cosines) in zip(asking, found, strict=True):
            near = rows @ rows[i]
            near[i] = -9
            assert np.allclose(near[places], cosines)
            hits += len(set(places[np.argsort(-cosines)][:5].tolist()) & set(np.argsort(-near)[:5].tolist()))
        assert hits >= 0.98 * 5 * len(asking)


def test_neighbours_start_does_not_decide_what_is_found():
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((400, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    directions = np.random.default_rng(3).standard_normal((8, 512))
    index = neighbours.Index(unit, directions, 64, 2.4, 5)
    for index.start in (1.0, 0.9, 0.3, 0.0, -1.0):
        for own in (-1, 7):
            places, cosines = index.nearest(unit[7], unit[7] @ directions, own, 5)
            near = unit @ unit[7]
            near[7] = 1 if own < 0 else -9
            assert sorted(places.tolist()) == sorted(np.argsort(-near)[:5].tolist())
    places, _ = index.nearest(-unit[7], -unit[7] @ directions, -1, 400)  # more asked for than lie on its side
    assert sorted(places.tolist()) == list(range(400))


def test_neighbours_bound_from_the_first_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 60)
    monkeypatch.setattr(neighbours, "PART", 7)
    x = np.random.default_rng(8).standard_normal((500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[50].tolist()) for i in range(90)]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 4.1]), (2002, [-1.0, 0.5]), (2050, [1.0]), (None, x[7].tolist())]  # fewer than k in all
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    by = {}
    for r in sorted(neighbours.search(table).collect(), key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, v in [(i, v) for i, v in rows if i is not None and i % 50 == 0 and len(v) == 16]:
        scores = sorted((cosine(v, w) for j, w in rows if j != q and len(w) == 16), reverse=True)[:5]
        hits += sum(s >= scores[-1] - 1e-9 for _, s in by[q])
        assert len(by[q]) == 5
    assert hits >= 0.97 * 5 * 12
    assert [j for j, _ in by[50]] == [1000, 1001, 1002, 1003, 1004] and [j for j, _ in by[1050]] == [50, 1000, 1001, 1002, 1003]
    assert [j for j, _ in by[2000]] == [2001, 2002] and 2050 not in by


def test_neighbours_with_a_bound_give_no_less():
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    directions = np.random.default_rng(3).standard_normal((64, 1024))
    index = neighbours.Index(unit, directions, 64, 2.4, 5)
    hits = wanted = 0
    for q in rng.standard_normal((40, 64)):
        q /= np.linalg.norm(q)
        near = np.sort(unit @ q)[::-1]
        for bound in (near[0] + 0.01, near[2], near[4], near[7], -0.5):
            found, cosines = index.nearest(q, q @ directions, -1, 5, bound)
            assert (cosines >= bound - 1e-9).all() and len(found) <= 5
            hits += len(found)
            wanted += min(5, int((near >= bound - 1e-9).sum()))
    assert 0.98 * wanted <= hits <= wanted

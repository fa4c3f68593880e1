"""Newton steps on sums against brute force, the split, languages by script, and lists that grew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.operators import corpus, learn, scoring


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def test_fnv(spark):
    texts = ["", "a", "foobar", "m17@x.test", "naïve 日本 🙂", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(learn.fnv1a(F.col("t"))).collect()] == [None if t is None else fnv(t) for t in texts]
    assert fnv("a") == 0xE40C292C and fnv("foobar") == 0xBF9CF968  # the published vectors


def test_weights_are_those_of_a_brute_force_fit(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        a, b, c = rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.2
        rows.append((i, int(a), int(b), int(c) if rng.random() < 0.95 else None, int(rng.random() < 1 / (1 + math.exp(-(2 * a - 3 * b + 0.5 * c - 1.2))))))
    model = learn.fit(spark.createDataFrame(rows, "message_id long, a int, b int, c int, label int"), ["a", "b", "c"])
    bad = sum(r[4] for r in rows)
    weight = {1: max(1, (900 - bad) / bad), 0: max(1, bad / (900 - bad))}
    seen = [r for r in rows if fnv(str(r[0])) % 1000 >= 200]
    x = np.array([[r[1], r[2], r[3] or 0, 1] for r in seen], float)
    y, w = np.array([r[4] for r in seen], float), np.array([weight[r[4]] for r in seen])
    beta = np.zeros(4)
    for _ in range(20_000):  # plain descent on the rows themselves
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= 1.0 * ((x * (w * (p - y))[:, None]).sum(0) / w.sum() + 0.01 * beta * [1, 1, 1, 0])
    assert np.allclose([*model["weights"].values(), model["intercept"]], beta, atol=1e-6)
    held = [r for r in rows if fnv(str(r[0])) % 1000 < 200]
    right = sum((np.array([r[1], r[2], r[3] or 0, 1]) @ beta > 0) == r[4] for r in held)
    assert model["accuracy"] == right / len(held) and model["useful"]
    assert learn.explain(model, 1)[0][0] == "b"
    with pytest.raises(ValueError):
        learn.fit(spark.createDataFrame(rows[:30], "message_id long, a int, b int, c int, label int"), ["a"])


def test_languages_by_script(spark):
    texts = {
        "japanese": "漢字とかなの文", "korean": "한국어 문장", "chinese": "没有假名的中文", "russian": "Русский язык", "greek": "Ελληνικά", "arabic": "اللغة العربية", "hebrew": "עברית", "thai": "ภาษาไทย", "hindi": "हिंदी वाक्य",
        "german": "Der Hund und die Katze sind von mir", "english": "The dog and the cat are in that house", "french": "Le chat est dans la maison et les enfants", "spanish": "El perro y los gatos con una de las casas",
    }
    nothing = ["", "123 !", "two words", "qwrt zxcv bnmp lkjh", None, "abc Это de fgh"]
    df = spark.createDataFrame([(t,) for t in [*texts.values(), *nothing]], "t string")
    got = [r[0] and r[0].language for r in df.select(scoring.detected(F.col("t"))).collect()]
    assert got == [*texts, *[None] * len(nothing)]
    own = spark.range(1).select(scoring.detected(F.lit("ja tak nie jest jako"), {"polish": ["nie", "jest", "jako", "przez"], "other": ["tak"] * 1 + ["x"] * 9}).alias("d")).first().d
    assert (own.language, own.confidence) == ("polish", 0.75 - 0.1)


def test_a_grown_list_finds_what_a_full_sweep_finds(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice(["A.test", "b.test", "c.test", "d.test", None, ""])) for i in range(300)]
    links = spark.createDataFrame(rows, "message_id long, value string")
    path = str(tmp_path / "index")
    corpus.index_values(links.where("message_id < 200"), path)
    corpus.index_values(links.where("message_id >= 200"), path)
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    known = spark.createDataFrame([(i, "list", "bad") for i in range(0, 300, 3)], "message_id long, kind string, source string")
    found = corpus.grown_list(spark, path, of("b.test", "gone.test"), of("B.TEST", "a.test", "", "d.test", "new.test"), known, "bad")
    assert sorted((r.message_id, r.value) for r in found.collect()) == sorted({(i, v.lower()) for i, v in rows if v and v.lower() in ("a.test", "d.test") and i % 3})
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert corpus.grown_list(spark, path, of("a.test"), of("A.test"), known, "bad").collect() == []

"""Agreement with reviewers: a logistic model over named binary features, by Spark ML, or by Newton steps on sums over patterns of features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.sources.shared import stored


def held_out(key: Column, percent: int = 20) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(100)) < percent


def train(examples: DataFrame, features: list[str], key: str = "message_id", label: str = "label", least: int = 50, least_of_class: int = 10, steps: int = 100) -> dict:
    """{weights by feature, accuracy on the held-out fifth, baseline, useful}; classes weigh alike. ValueError below the least numbers."""
    counts = {r[0]: r[1] for r in examples.groupBy(label).count().collect()}
    n = sum(counts.values())
    if n < least or min(counts.get(0, 0), counts.get(1, 0)) < least_of_class:
        raise ValueError(f"needs {least} reviews and {least_of_class} of each kind; has {counts}")
    weight = F.when(F.col(label) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    table = examples.select(key, F.col(label).cast("double").alias("label"), weight.alias("w"), *[F.col(f).cast("double").alias(f) for f in features])
    table = VectorAssembler(inputCols=features, outputCol="x").transform(table).withColumn("held", held_out(F.col(key)))
    model = LogisticRegression(featuresCol="x", weightCol="w", regParam=0.01, maxIter=steps).fit(table.where("not held"))
    scored = model.transform(table.where("held")).agg(F.avg(F.expr("cast(prediction = label as int)")).alias("accuracy"), F.avg("label").alias("positive")).first()
    baseline = max(scored["positive"], 1 - scored["positive"])
    weights = dict(zip(features, (float(x) for x in model.coefficients), strict=True))
    return {"weights": weights, "intercept": float(model.intercept), "accuracy": scored["accuracy"], "baseline": baseline, "useful": scored["accuracy"] > baseline + 0.02}


def score(df: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """The model's probability as a Column expression."""
    z = F.lit(model["intercept"])
    for f, w in model["weights"].items():
        z = z + F.col(f).cast("double") * w
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def explain(model: dict, n: int = 10) -> list[tuple[str, float]]:
    return sorted(model["weights"].items(), key=lambda x: (-abs(x[1]), x[0]))[:n]


def fnv1a(x: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    code = F.hex(F.encode(x, "UTF-8"))
    n = (F.length(code) / 2).cast("int")
    octets = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(x.isNotNull(), F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % (1 << 32)))


def split(key: Column, share: float = 0.2) -> Column:
    """Whether a row is held out: by its key alone, so that a message stays on its side when others are reviewed."""
    return fnv1a(key.cast("string")) % 1000 < int(share * 1000)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a symmetric positive matrix of a few dozen rows, by elimination in plain array steps."""
    work = np.concatenate([a, b[:, None]], 1)
    for i in range(len(b)):
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, -1]


def fit(examples: DataFrame, features: list[str], key: str = "message_id", label: str = "label", least: int = 50, least_of_class: int = 10, l2: float = 0.01, tolerance: float = 1e-9) -> dict:
    """{weights, intercept, examples, accuracy on the held-out fifth, baseline, useful}: the minimum of the mean weighted log loss plus l2 / 2 times
    the squared weights. Rows are grouped by their pattern of features once; each Newton step is one row of sums over the patterns. The
    rarer class weighs so much more that both weigh alike. ValueError below the least numbers of reviews."""
    x = [f"_x{i}" for i in range(len(features))]
    rows = examples.select(split(F.col(key)).alias("_held"), F.col(label).cast("double").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(c) for f, c in zip(features, x, strict=True)])
    table = stored(rows.groupBy("_held", *x).agg(F.sum("_y").alias("_bad"), F.count("*").alias("_n")), "patterns")
    n, bad = (float(v or 0) for v in table.agg(F.sum("_n"), F.sum("_bad")).first())
    good = n - bad
    if n < least or min(bad, good) < least_of_class:
        raise ValueError(f"needs {least} reviews and {least_of_class} of each kind; has {bad:.0f} and {good:.0f}")
    w_bad, w_good = max(1.0, good / bad), max(1.0, bad / good)
    seen = table.where("not _held").withColumns({"_b": w_bad * F.col("_bad"), "_w": w_bad * F.col("_bad") + w_good * (F.col("_n") - F.col("_bad"))})
    columns, k = [*map(F.col, x), F.lit(1.0)], len(x) + 1
    total = float(seen.agg(F.sum("_w")).first()[0])
    beta, ridge = np.zeros(k), np.diag([l2] * (k - 1) + [0.0])
    places = [(i, j) for i in range(k) for j in range(i, k)]
    while True:
        z = sum((c * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        gradient = [F.sum(c * (F.col("_w") * p - F.col("_b"))) for c in columns]
        curve = [F.sum(columns[i] * columns[j] * F.col("_w") * p * (1 - p)) for i, j in places]
        sums = seen.agg(*gradient, *curve).first()
        g = np.array(sums[:k]) / total + ridge @ beta
        h = np.zeros((k, k))
        for (i, j), v in zip(places, sums[k:], strict=True):
            h[i, j] = h[j, i] = v / total
        step = _solved(h + ridge + 1e-12 * np.eye(k), g)
        beta = beta - step
        if np.abs(step).max() < tolerance:
            break
    model = {"weights": dict(zip(features, beta[:-1].tolist(), strict=True)), "intercept": float(beta[-1]), "examples": int(n)}
    z = sum((c * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
    said = F.when(z > 0, F.col("_bad")).otherwise(F.col("_n") - F.col("_bad"))
    held = table.where("_held").agg(F.sum(said), F.sum("_bad"), F.sum("_n")).first()
    model["accuracy"] = held[0] / held[2] if held[2] else None
    model["baseline"] = max(held[1], held[2] - held[1]) / held[2] if held[2] else None
    return model | {"useful": bool(held[2]) and model["accuracy"] > model["baseline"] + 0.02}

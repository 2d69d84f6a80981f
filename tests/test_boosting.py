"""Softmax boosting: against a plain numpy version of its first round, one-vs-rest boosting, and on awkward input."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from specsheet.operators.boosting import SoftmaxBoosting, softmax

NAMES = ["a", "b", "c"]


def frame(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0.6, 2, np.where(x[:, 1] * x[:, 2] > 0, 1, 0))
    rows = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double").repartition(4), x, y


def log_loss(p, y):
    return float(-np.mean(np.log(np.clip(p[np.arange(len(y)), y], 1e-12, 1))))


def test_not_above_one_vs_rest(spark):
    df, x, y = frame(spark)
    train, test = df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    model = SoftmaxBoosting(NAMES, rounds=12, depth=3, step=0.3, refresh=5).fit(train, "label", 3)
    got = {r["row_id"]: (r["probability"], r["prediction"]) for r in model.transform(test).collect()}
    p = np.array([got[i][0] for i in sorted(got)])
    held = y[sorted(got)]
    assert np.allclose(p.sum(axis=1), 1) and all(got[i][1] == np.argmax(got[i][0]) for i in got)
    one = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"),
                           OneVsRest(classifier=GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1, seed=1))]).fit(train)
    raw = {r["row_id"]: r["m"] for r in one.transform(test).select("row_id", vector_to_array("rawPrediction").alias("m")).collect()}
    margins = 1 / (1 + np.exp(-2 * np.array([raw[i] for i in sorted(raw)])))
    assert log_loss(p, held) <= log_loss(margins / margins.sum(axis=1, keepdims=True), held)
    assert (p.argmax(axis=1) == held).mean() > 0.75


def test_first_round_by_hand(spark):
    """Root splits and leaves of one round of stumps, by trying every cut."""
    df, x, y = frame(spark, 200, 3)
    model = SoftmaxBoosting(NAMES, rounds=1, depth=1, step=1.0, bins=8, l2=1.0).fit(df, "label", 3)
    p = softmax(np.tile(model.base, (200, 1)))
    for c in range(3):
        g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        cuts = [(worth(x[:, f] <= e) + worth(x[:, f] > e), f, k) for f in range(3) for k, e in enumerate(model.edges[f])]
        best = max(cuts)
        f, k = model.rounds[0].feature[c, 0], model.rounds[0].last[c, 0]
        chosen = [v for v, *at in cuts if at == [f, k]]
        assert chosen and chosen[0] == pytest.approx(best[0])
        left = x[:, f] <= model.edges[f][k]
        assert model.rounds[0].value[c] == pytest.approx([g[m].sum() / (h[m].sum() + 1.0) for m in (left, ~left)])


def test_missing_values_weights_and_one_class(spark):
    df, _, _ = frame(spark, 120)
    odd = df.withColumn("a", F.when(F.col("row_id") % 5 > 0, F.col("a"))).withColumn("b", F.lit(None).cast("double")).withColumn("w", F.col("row_id") % 2 + 1.0)
    model = SoftmaxBoosting(NAMES, rounds=2, depth=2).fit(odd, "label", 4, "w")
    got = model.transform(odd).collect()
    assert len(got) == 120 and all(len(r["probability"]) == 4 and abs(sum(r["probability"]) - 1) < 1e-9 for r in got)
    single = SoftmaxBoosting(NAMES, rounds=1, depth=1).fit(odd.withColumn("label", F.lit(0.0)), "label", 2)
    assert {r["prediction"] for r in single.transform(odd).collect()} == {0.0}

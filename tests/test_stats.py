"""Bounded-memory exact quantiles and hash-order splits against brute force, including a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsheet.functions.stats import quantiles
from specsheet.operators import metrics as M


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 30000
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 50, n).astype(str))  # a third in one key
    val = np.round(rng.lognormal(3, 1, n), 2)
    rows = [(int(i), str(k), float(v)) for i, (k, v) in enumerate(zip(key, val))]
    return spark.createDataFrame(rows, "id long, k string, v double"), key, val


def test_quantiles_exact_with_hot_key(skewed):
    df, key, val = skewed
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    for refine in (False, True):
        got = {r["k"]: r for r in quantiles(df, "v", probs, by="k", accuracy=200, refine=refine).collect()}
        for k in ["hot", "3"]:
            want = np.quantile(val[key == k], probs)
            for j, w in enumerate(want):
                assert got[k][f"q{j}"] == pytest.approx(w, abs=1e-9), (k, probs[j], refine)
    for k in ["hot", "3", "17"]:
        xs = val[key == k]
        want = np.quantile(xs, probs)  # linear interpolation
        for j, w in enumerate(want):
            assert got[k][f"q{j}"] == pytest.approx(w, abs=1e-9), (k, probs[j])


def test_quantiles_small_groups(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 3.0)], "g int, v double")
    got = {r["g"]: r["q0"] for r in quantiles(df, "v", [0.5], by="g").collect()}
    assert got == {1: 6.0, 2: 3.0}


def test_stratified_split_exact_counts(skewed):
    df, key, _ = skewed
    s = M.stratified_split(df, "k", 0.2, 42, "id")
    got = {(r["k"], r["is_validation"]): r["count"] for r in s.groupBy("k", "is_validation").count().collect()}
    for k in ["hot", "3"]:
        n = int((key == k).sum())
        assert got[(k, True)] == int(np.floor(0.2 * n + 0.5))
        assert got[(k, True)] + got[(k, False)] == n


def test_folds_balanced(skewed):
    df, key, _ = skewed
    f = M.stratified_folds(df, "k", 5, 1, "id")
    sizes = f.where("k = 'hot'").groupBy("fold").count().collect()
    c = sorted(r["count"] for r in sizes)
    assert len(c) == 5 and c[-1] - c[0] <= 1
    cf = M.contiguous_folds(df.where("k = '3'"), 5, "id")
    b = cf.groupBy("fold").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")) \
        .orderBy("fold").collect()
    assert all(b[i]["hi"] < b[i + 1]["lo"] for i in range(4))
    assert [r["n"] for r in b] == sorted([r["n"] for r in b], reverse=True)


def test_approximate_quantiles_close(skewed):
    df, key, val = skewed
    got = {r["k"]: r for r in quantiles(df, "v", [0.5], by="k", exact=False, bounds=True).collect()}
    xs = np.sort(val[key == "hot"])
    r = got["hot"]
    rank = np.searchsorted(xs, r["q0"])
    assert abs(rank / len(xs) - 0.5) < 0.01
    assert r["min"] == xs[0] and r["max"] == xs[-1]


def test_quantile_bounds_and_carried(skewed):
    df, key, val = skewed
    r = quantiles(df.where("k = '3'"), "v", [0.9], bounds=True,
                  aggs=[F.count(F.lit(1)).alias("rows"), F.avg("v").alias("mean")]).first()
    xs = np.sort(val[key == "3"])
    q = np.quantile(xs, 0.9)
    assert r["q0"] == pytest.approx(q) and r["min"] == xs[0] and r["max"] == xs[-1]
    assert r["qle0"] == xs[xs <= q + 1e-12].max()
    assert r["rows"] == len(xs) and r["mean"] == pytest.approx(xs.mean())


def test_random_split_exact(skewed):
    df, _, _ = skewed
    s = M.random_split(df, 0.25, 7, "id")
    assert s.where("is_validation").count() == round(0.25 * 30000)


@pytest.mark.parametrize("accuracy", [20, 100])
def test_refined_quantiles_exact_at_low_accuracy(skewed, accuracy):
    """A coarse sketch leaves wide brackets; the refinement pass must still land every rank."""
    df, key, val = skewed
    probs = [0.0, 0.01, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = {r["k"]: r for r in quantiles(df, "v", probs, by="k", accuracy=accuracy, refine=True).collect()}
    for k in ["hot", "7"]:
        want = np.quantile(val[key == k], probs)
        for j, w in enumerate(want):
            assert got[k][f"q{j}"] == pytest.approx(w, abs=1e-9), (k, probs[j], accuracy)


def test_class_with_one_member(spark):
    rows = [(i, "big" if i < 50 else "solo") for i in range(51)]
    df = spark.createDataFrame(rows, "id long, c string")
    s = {(r["c"], r["is_validation"]): r["count"]
         for r in M.stratified_split(df, "c", 0.2, 42, "id").groupBy("c", "is_validation").count().collect()}
    assert s[("big", True)] == 10 and s[("solo", False)] == 1 and ("solo", True) not in s
    f = M.stratified_folds(df, "c", 5, 42, "id")
    assert f.where("c = 'solo'").count() == 1 and f.where("fold IS NULL").count() == 0
    sizes = sorted(r["count"] for r in f.where("c = 'big'").groupBy("fold").count().collect())
    assert sizes == [10] * 5

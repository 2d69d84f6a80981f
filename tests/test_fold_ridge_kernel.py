"""One-pass ridge folds, kernel-weighted attributions, sparse one-hot vectors, digest-first duplicates, staged charts."""

import numpy as np
import pytest
from paths import SF001
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from specsheet.operators import explain as E
from specsheet.operators import features, metrics, quality
from specsheet.operators.models import PricePredictor, regression_candidates
from specsheet.operators.ridge import ridge_fold_scores


def regression_frame(spark, n=500, d=4):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d)) * [1, 10, 100, 1][:d] + 1e4
    y = x @ np.arange(1, d + 1) + rng.normal(size=n) * 50
    names = [f"x{i}" for i in range(d)]
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "row_id long, " + ", ".join(f"{c} double" for c in names) + ", y double"), x, y, names


def test_ridge_folds_against_refits(spark):
    df, x, y, names = regression_frame(spark)
    folds = metrics.contiguous_folds(df, 5, "row_id")
    got = ridge_fold_scores(folds, names, "y")
    fold = np.repeat(np.arange(5), 100)
    for k in range(5):
        a, b = x[fold != k], y[fold != k]
        ma, mb = a.mean(axis=0), b.mean()
        w = np.linalg.solve((a - ma).T @ (a - ma) + np.eye(x.shape[1]), (a - ma).T @ (b - mb))
        e = y[fold == k] - (mb + (x[fold == k] - ma) @ w)
        assert got[k] == pytest.approx(1 - (e @ e) / ((y[fold == k] - y[fold == k].mean()) ** 2).sum(), abs=1e-8)


def test_cross_validation_uses_them_and_agrees_with_fits(spark):
    df, _, _, names = regression_frame(spark, 200, 3)
    ridge = regression_candidates()["ridge"]
    fitted = ridge.copy()
    fitted.setRegParam(float(df.agg(F.stddev_pop("y")).first()[0]) / 160)  # set: goes through the fits
    cv = PricePredictor(names, candidates={"once": ridge, "fits": fitted}).cross_validate(df, "y", 5).collect()
    once, fits = ({r["fold"]: r["r2"] for r in cv if r["model"] == m} for m in ("once", "fits"))
    assert len(once) == 5 and all(once[k] == pytest.approx(fits[k], abs=1e-4) for k in once)


def test_a_constant_fold_has_no_score(spark):
    df = spark.createDataFrame([(float(i), 5.0 if i < 4 else float(i * i), 0 if i < 4 else 1) for i in range(12)], "x double, y double, fold int")
    got = ridge_fold_scores(df, ["x"], "y")
    assert got[0] is None and got[1] is not None


def forest(spark, d, n=300):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d))
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0, 2 * x[:, 2], -x[:, 2]) + x[:, 3 % d] ** 2
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, " + ", ".join(f"{c} double" for c in names) + ", label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), RandomForestRegressor(numTrees=5, maxDepth=4, seed=1)]).fit(df)
    return df, model, names


def test_kernel_is_exact_where_all_coalitions_are_taken(spark):
    df, model, names = forest(spark, 5)
    rows, bg = df.limit(12), df.orderBy(F.desc("row_id")).limit(10)
    one = {(r["row_id"], r["feature"]): (r["shap_value"], r["base_value"]) for r in E.kernel_shap(rows, model, names, bg).collect()}
    two = {(r["row_id"], r["feature"]): (r["shap_value"], r["base_value"]) for r in E.exact_shap(rows, model, names, bg).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == pytest.approx(two[k], abs=1e-8)


def test_sampled_coalitions_come_near_and_add_up(spark):
    df, model, names = forest(spark, 9)
    rows, bg = df.limit(6), df.orderBy(F.desc("row_id")).limit(5)
    exact = {(r["row_id"], r["feature"]): r["shap_value"] for r in E.exact_shap(rows, model, names, bg).collect()}
    near = E.kernel_shap(rows, model, names, bg, samples=200).collect()
    spread = np.std(list(exact.values()))
    assert np.mean([abs(r["shap_value"] - exact[r["row_id"], r["feature"]]) for r in near]) < 0.1 * spread
    predicted = {r["row_id"]: r["prediction"] for r in model.transform(rows).collect()}
    for i, p in predicted.items():
        own = [r for r in near if r["row_id"] == i]
        assert own[0]["base_value"] + sum(r["shap_value"] for r in own) == pytest.approx(p, abs=1e-8)


def test_thirty_features(spark):
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(30)]
    x, w = rng.normal(size=(5, 30)), rng.normal(size=30)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in names))
    model = SQLTransformer(statement="SELECT *, " + " + ".join(f"{v!r} * {c}" for v, c in zip(w.tolist(), names)) + " AS prediction FROM __THIS__")
    got = E.kernel_shap(df, model, names, df, samples=300).collect()
    assert len(got) == 150
    for r in got:
        i = int(r["feature"][1:])
        assert r["shap_value"] == pytest.approx(w[i] * (x[r["row_id"], i] - x[:, i].mean()), abs=1e-8)
    z, coefficients = E.kernel_weights(1, 10)
    assert len(z) == 0 and coefficients.tolist() == [[-1.0], [1.0]]


def test_one_hot_vectors_of_many_values(spark):
    df = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("c"))
    out, mappings = features.one_hot_vectors(df, ["c"])
    assert mappings["c"].count() == 180_000
    some = out.where("id IN (0, 1, 2, 199999)").select("id", "c_Vector").collect()
    for r in some:
        v = r["c_Vector"]
        assert v.size == 180_000 and len(v.indices) == (0 if r["id"] % 10 == 0 else 1)
    assert {r["id"]: int(r["c_Vector"].indices[0]) for r in some if r["id"] % 10} == {1: 0, 2: 1, 199999: 179_999}
    small, _ = features.one_hot_vectors(spark.createDataFrame([("b",), ("a",), (None,)], "x string"), ["x"])
    assert {r[0]: r[1] for r in small.select("x", vector_to_array("x_Vector")).collect()} == {"b": [0.0, 1.0], "a": [1.0, 0.0], None: [0.0, 0.0]}


def test_digest_first_duplicates(spark):
    rows = [(None, "a", 1.0), ("a", None, 1.0), (None, "a", 1.0), ("a", "b", None), ("a", "b", None), ("a", "b", 0.0), ("a", "b", -0.0), ("x", "y", float("nan")),
            ("x", "y", float("nan")), ("only", "one", 3.0)]
    df = spark.createDataFrame(rows, "p string, q string, r double")
    assert quality.duplicate_rows(df).first()["duplicates"] == 4
    assert quality.duplicate_rows(df, ["p"]).first()["duplicates"] == 6
    assert quality.duplicate_rows(df.where("false")).first()["duplicates"] == 0


def test_a_failing_chart_leaves_old_data(spark, tmp_path, monkeypatch):
    from specsheet.plans.pipeline import specs
    from specsheet.sinks import charts as sink

    df, out = specs(spark, SF001), str(tmp_path / "charts")
    first = sink.write_chart_data(df, out)
    before = {r["chart"]: r["run"] for r in sink.read_manifest(spark, out)}
    assert len(first) == len(before) and all(before.values())
    plan = sink.chart_plan

    def broken(frame):
        charts = plan(frame)
        charts["price_histogram"] = lambda: frame.select(F.raise_error(F.lit("no chart")).alias("x"))
        return charts

    monkeypatch.setattr(sink, "chart_plan", broken)
    second = sink.write_chart_data(df, out)
    after = {r["chart"]: r for r in sink.read_manifest(spark, out)}
    assert len(second) == len(first) - 1 and "no chart" in after["price_histogram"]["error"]
    assert after["price_histogram"]["run"] == before["price_histogram"]
    assert spark.read.parquet(f"{out}/price_histogram").count() == 50
    assert all(r["run"] != before[c] for c, r in after.items() if c != "price_histogram")
    assert not [p.name for p in (tmp_path / "charts").iterdir() if p.name.startswith("_staging")]


def test_fold_weights_equal_balanced_weights(spark):
    from specsheet.operators.models import PerformanceClassifier, _fold_weights

    rows = [(i, float(i % 7 % 3), i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, label double, fold int")
    sizes = {(r["fold"], r["label"]): r["count"] for r in df.groupBy("fold", "label").count().collect()}
    for k in range(4):
        want = {r["label"]: r["weight"] for r in metrics.balanced_weights(df.where(F.col("fold") != k), "label").collect()}
        assert _fold_weights(sizes, k) == pytest.approx(want)
    assert "Acceleration_Sec" not in PerformanceClassifier(drop_leaky=True, fast=True).feature_cols
    assert "Acceleration_Sec" in PerformanceClassifier(fast=True).feature_cols


def test_background_sample_is_seeded_and_spread(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    one = sorted(r[0] for r in E.background_sample(df, 100).collect())
    assert one == sorted(r[0] for r in E.background_sample(df.repartition(7), 100).collect()) and len(one) == 100
    assert one != sorted(r[0] for r in E.background_sample(df, 100, seed=1).collect())
    assert 1500 < sum(one) / 100 < 3500

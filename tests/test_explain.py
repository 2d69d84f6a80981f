"""Tree attributions equal brute-force Shapley values of the path-dependent game."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from specsheet.operators import explain as E
from specsheet.operators.models import PricePredictor

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11), float((i * 5) % 13), float(i % 4),
             float((i % 7) * 10 + ((i * 3) % 11) * ((i % 4) + 1) + (i % 13))) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double")


def _brute(spark, model, x, weights):
    rows = E.node_table(spark, E._tree_model(model)).collect()
    trees = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def ev(nodes, nid, S):
        r = nodes[nid]
        if r["leftChild"] < 0:
            return r["prediction"]
        f = r["f"]
        left, right = nodes[r["leftChild"]], nodes[r["rightChild"]]
        if f in S:
            return ev(nodes, r["leftChild"] if x[f] <= r["thr"] else r["rightChild"], S)
        cl, cr = left["impurityStats"][0], right["impurityStats"][0]
        return (cl * ev(nodes, r["leftChild"], S) + cr * ev(nodes, r["rightChild"], S)) / (cl + cr)

    def v(S):
        return sum(weights[t] * ev(nodes, min(nodes), S) for t, nodes in trees.items())

    d = len(x)
    phi = []
    for i in range(d):
        tot = 0.0
        others = [j for j in range(d) if j != i]
        for m in range(d):
            for S in combinations(others, m):
                w = math.factorial(m) * math.factorial(d - m - 1) / math.factorial(d)
                tot += w * (v(set(S) | {i}) - v(set(S)))
        phi.append(tot)
    return phi, v(set())


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_tree_shap_matches_brute_force(spark, data, kind):
    est = RandomForestRegressor(numTrees=3, maxDepth=3, seed=7) if kind == "rf" else \
        GBTRegressor(maxIter=3, maxDepth=3, seed=7)
    pp = PricePredictor(FEATS, candidates={kind: est})
    pp.train(data, "y", validate=False)
    model = pp.models[kind]
    tm = E._tree_model(model)
    weights = [1.0 / tm.getNumTrees] * tm.getNumTrees if kind == "rf" else list(tm.treeWeights)
    phi = E.tree_shap(data, model, FEATS)
    got = {(r["row_id"], r["feature"]): (r["shap_value"], r["base_value"]) for r in phi.collect()}
    for rid in (0, 13, 101):
        x = [float(v) for v in data.where(F.col("row_id") == rid).select(*FEATS).first()]
        want, base = _brute(spark, model, x, weights)
        for j, f in enumerate(FEATS):
            assert got[(rid, f)][0] == pytest.approx(want[j], abs=1e-7)
            assert got[(rid, f)][1] == pytest.approx(base, abs=1e-7)
    # additivity on every row
    recon = phi.groupBy("row_id").agg((F.first("base_value") + F.sum("shap_value")).alias("r"))
    pred = pp.predict(data).select("row_id", "prediction")
    err = recon.join(pred, "row_id").agg(F.max(F.abs(F.col("r") - F.col("prediction")))).first()[0]
    assert err < 1e-7


def test_linear_and_exact_agree(spark, data):
    from pyspark.ml.regression import LinearRegression

    pp = PricePredictor(FEATS, candidates={"lr": LinearRegression()})
    pp.train(data, "y", validate=False)
    w, b = E.linear_weights(pp.models["lr"], FEATS)
    bg = E.background_sample(data, 20)
    lin = {(r["row_id"], r["feature"]): r["shap_value"] for r in E.linear_shap(data, w, bg, intercept=b).collect()}
    ex = E.exact_shap(data.where(F.col("row_id") < 5), pp.models["lr"], FEATS, bg).collect()
    assert len(ex) == 5 * len(FEATS)
    for r in ex:
        assert r["shap_value"] == pytest.approx(lin[(r["row_id"], r["feature"])], abs=1e-6)


def test_summaries(spark, data):
    pp = PricePredictor(FEATS, candidates={"rf": RandomForestRegressor(numTrees=3, maxDepth=3, seed=1)})
    pp.train(data, "y", validate=False)
    phi = E.tree_shap(data, pp.models["rf"], FEATS)
    imp = E.shap_importance(phi).collect()
    assert [r["importance"] for r in imp] == sorted([r["importance"] for r in imp], reverse=True)
    ex = E.explain_rows(phi).where("row_id = 3").first()
    assert len(ex["contributions"]) == len(FEATS)
    assert all(c["shap_value"] > 0 for c in ex["top_positive"])
    txt = E.explanation_text(E.explain_rows(phi)).where("row_id = 3").first()["text"]
    assert txt.startswith("Predicted value: $")
    force = E.shap_force(phi).where("row_id = 3").orderBy("order").collect()
    assert force[-1]["cumulative"] == pytest.approx(ex["prediction"])


def test_deep_forest_adds_up_in_one_scan(spark, data, tmp_path):
    pp = PricePredictor(FEATS, candidates={"rf": RandomForestRegressor(numTrees=20, maxDepth=15, seed=3)})
    pp.train(data, "y", validate=False)
    data.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    phi = E.tree_shap(rows, pp.models["rf"], FEATS)
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    recon = phi.groupBy("row_id").agg((F.first("base_value") + F.sum("shap_value")).alias("r"))
    joined = recon.join(pp.predict(data).select("row_id", "prediction"), "row_id")
    assert joined.count() == 200 and joined.agg(F.max(F.abs(F.col("r") - F.col("prediction")))).first()[0] < 1e-7


def test_single_leaf_and_no_rows(spark, data):
    pp = PricePredictor(FEATS, candidates={"rf": RandomForestRegressor(numTrees=2, maxDepth=0, seed=3)})
    pp.train(data, "y", validate=False)
    phi = E.tree_shap(data, pp.models["rf"], FEATS)
    assert phi.count() == 200 * len(FEATS) and phi.where("shap_value <> 0").count() == 0
    assert E.tree_shap(data.where("row_id < 0"), pp.models["rf"], FEATS).count() == 0


def test_class_attributions_add_up_to_probabilities(spark, data):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = data.withColumn("label", (F.col("a") > 2).cast("double") + (F.col("b") > 6).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"),
                             RandomForestClassifier(numTrees=5, maxDepth=4, seed=2)]).fit(rows)
    phi = E.class_shap(rows, model, FEATS)
    got = {(r["row_id"], r["class"]): r["p"] for r in phi.groupBy("row_id", "class").agg(
        (F.first("base_value") + F.sum("shap_value")).alias("p")).collect()}
    assert len(got) == 600
    for row in model.transform(rows).select("row_id", vector_to_array("probability").alias("p")).collect():
        for c in range(3):
            assert got[(row["row_id"], c)] == pytest.approx(row["p"][c], abs=1e-9)
    one = {(r["row_id"], r["feature"]): r["shap_value"] for r in E.tree_shap(rows, model, FEATS, class_index=1).collect()}
    assert all(one[(r["row_id"], r["feature"])] == pytest.approx(r["shap_value"]) for r in phi.where("class = 1").collect())
    assert E.shap_importance(phi, by_class=True).count() == len(FEATS)


def test_exact_shap_scores_the_grid_once(spark, data):
    from pyspark.ml.feature import SQLTransformer

    model = SQLTransformer(statement="SELECT *, a * b + c AS prediction FROM __THIS__")
    bg = data.where("row_id < 10")
    phi = E.exact_shap(data, model, ["a", "b", "c"], bg)
    plan = phi._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 1
    means = bg.agg(F.avg("a"), F.avg("b"), F.avg("c"), F.avg(F.col("a") * F.col("b"))).first()
    for row in data.where("row_id in (3, 77)").collect():
        got = {r["feature"]: (r["shap_value"], r["base_value"]) for r in phi.where(F.col("row_id") == row["row_id"]).collect()}
        none, a, b, both = means[3], row["a"] * means[1], means[0] * row["b"], row["a"] * row["b"]
        assert got["a"] == pytest.approx(((a - none + both - b) / 2, none + means[2]))
        assert got["b"][0] == pytest.approx((b - none + both - a) / 2)
        assert got["c"][0] == pytest.approx(row["c"] - means[2])


def test_class_importance_does_not_cancel_and_rows_carry_values(spark):
    from pyspark.sql import Row

    phi = spark.createDataFrame([Row(row_id=r, feature=f, **{"class": c}, shap_value=v, base_value=0.0)
                                 for r, f, c, v in [(1, "a", 0, 2.0), (1, "a", 1, -2.0), (1, "b", 0, 1.0), (1, "b", 1, 1.0),
                                                    (2, "a", 0, 4.0), (2, "a", 1, 0.0), (2, "b", 0, 0.0), (2, "b", 1, 0.0)]])
    got = {r["feature"]: (r["importance"], r["std"]) for r in E.shap_importance(phi, by_class=True).collect()}
    assert got == {"a": (2.0, 0.0), "b": (0.5, 0.5)}
    values = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 5.0)], "row_id long, a double, b double")
    one = phi.where("class = 0").drop("class")
    rows = {r["row_id"]: r for r in E.explain_rows(one, values=values).collect()}
    assert [tuple(c) for c in rows[1]["contributions"]] == [("a", 2.0, 10.0), ("b", 1.0, 20.0)]
    assert [tuple(c) for c in rows[2]["contributions"]] == [("a", 4.0, None), ("b", 0.0, 5.0)]
    assert rows[2]["prediction"] == 4.0 and [c["feature"] for c in rows[2]["top_positive"]] == ["a"]


def test_patterns_are_worked_out_once_whatever_the_rows(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    low, high = np.full((70, 3), -np.inf), np.full((70, 3), np.inf)
    cuts = rng.random((70, 3))
    low[rng.random((70, 3)) < 0.4], high[rng.random((70, 3)) < 0.4] = 0.3, 0.7
    leaves = E.Leaves(low, high, np.where(np.isfinite(low) | np.isfinite(high), cuts, 1.0), rng.normal(size=(70, 2)))
    x = rng.random((900, 3))
    x[:4, 0] = [np.nan, np.inf, 0.3, 0.7]
    by_row = np.concatenate([E.leaf_sums(x[i : i + 7], leaves) for i in range(0, 900, 7)])  # fewer rows than patterns
    worked = []
    inner = E._shares
    monkeypatch.setattr(E, "_shares", lambda meets, *rest: worked.append(meets[0].size) or inner(meets, *rest))
    assert np.allclose(E.leaf_sums(x, leaves), by_row, atol=1e-12)
    assert sum(worked) == 8 * 70


def test_linear_grid_is_the_general_enumeration(spark, monkeypatch):
    """A linear model is scored in place: the same values, also for ids that repeat or are null and for missing values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    cols = ["a", "b", "c"]
    made = [(None if i in (60, 61) else i // 2 if i < 20 else i, float(i % 7), float(i * i % 11), None if i == 40 else float(i % 5)) for i in range(90)]
    rows = spark.createDataFrame(made, "row_id long, a double, b double, c double")
    whole = rows.dropna().withColumn("y", F.col("a") * 3 - F.col("b") * F.col("c"))
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), LinearRegression(labelCol="y")]).fit(whole)
    background = E.background_sample(whole, 15)
    quick = E.exact_shap(rows, model, cols, background)
    assert "MapInArrow" in quick._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(E, "_linear_scorer", lambda *_: None)
    found, general = ({(r["row_id"], r["feature"]): (r["shap_value"], r["base_value"]) for r in df.collect()}
                      for df in (quick, E.exact_shap(rows, model, cols, background)))
    assert len(general) == 79 * 3 and set(found) == set(general)
    np.testing.assert_allclose([found[k] for k in general], [general[k] for k in general], rtol=1e-9, atol=1e-9)

"""Adversarial inputs: empty table, one row, constant and all-null columns, zero vectors, ties."""

import pytest
from pyspark.sql import functions as F

from specsheet.operators import charts, features, profile, similar


def test_constant_and_null_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None, float(i)) for i in range(10)], "row_id long, c double, z double, x double")
    mm = features.scale_numerical_features(df, ["c", "x"], "minmax").select("c_Scaled").distinct().collect()
    assert [r[0] for r in mm] == [0.0]
    st = features.scale_numerical_features(df, ["c", "x"], "standard").select("c_Scaled").distinct().collect()
    assert [r[0] for r in st] == [0.0]
    h = charts.histogram(df, "c", 10, None).collect()
    assert sum(r["count"] for r in h) == 10 and [r["count"] for r in h if r["count"]] == [10]
    assert h[5]["count"] == 10  # the middle bin of [v - 0.5, v + 0.5]
    fm = features.feature_matrix(df, ["c", "z", "x"]).select("f0", "f1").distinct().collect()
    assert [(r[0], r[1]) for r in fm] == [(0.0, 0.0)]


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "row_id long, v double")
    d = profile.price_distribution(empty, "v").collect()
    assert len(d) == 1 and d[0]["count"] == 0 and d[0]["median"] is None
    one = spark.createDataFrame([(1, 3.0)], "row_id long, v double")
    d1 = profile.price_distribution(one, "v").first()
    assert d1["median"] == 3.0 and d1["skewness"] is None


def test_zero_vector_and_ties(spark):
    rows = [(1, "A", "x1", 0.0, 0.0), (2, "A", "x2", 1.0, 1.0), (3, "B", "x3", 1.0, 1.0), (4, "B", "x4", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "row_id long, Company_Clean string, Car_Name_Clean string, p double, q double")
    rec = similar.Recommender(["p", "q"]).fit(df)
    out = rec.similar([2], n=3).orderBy("rank").collect()
    assert [r["row_id"] for r in out] == [3, 4, 1]  # equal scores: lower id first; zero vector last
    assert out[-1]["similarity_score"] == 0.0
    other = rec.similar([2], n=5, exclude_same_brand=True).collect()
    assert {r["Company_Clean"] for r in other} == {"B"}
    assert rec.coverage().first()[0] == 1.0


def test_zero_hp_ratio(spark):
    df = spark.createDataFrame([(100.0, 0.0, 0.0)], "Price_USD double, HorsePower_Numeric double, Speed_KMH double")
    r = features.create_power_to_speed_ratio(features.create_price_per_hp(df)).first()
    assert r["Price_Per_HP"] is None and r["Power_To_Speed_Ratio"] is None


def test_regression_metrics_zero_target(spark):
    from specsheet.operators.metrics import regression_metrics

    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    m = regression_metrics(df, "y", "p").first()
    assert m["mape"] is None and m["rmse"] > 0
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert regression_metrics(const, "y", "p").first()["r2"] is None


def test_issue_text_rounds_like_python(spark):
    from specsheet.operators.quality import validate_issues

    for missing, n in [(1, 8), (49, 400), (3, 7), (150, 1000)]:
        rows = [(None if i < missing else 1.0,) for i in range(n)]
        df = spark.createDataFrame(rows, "x double")
        got = validate_issues(df, limit=0.0).first()["issue"]
        assert got == f"Column 'x' has {missing} missing values ({missing / n * 100:.1f}%)", got


def test_explain_pair(spark):
    rows = [(1, "A", "x1", 1.0, 2.0), (2, "B", "x2", 2.0, 2.0), (3, "B", "x3", 3.0, 0.0)]
    df = spark.createDataFrame(rows, "row_id long, Company_Clean string, Car_Name_Clean string, p double, q double")
    rec = similar.Recommender(["p", "q"]).fit(df)
    e = {r["feature"]: r for r in rec.explain(1, 2).collect()}
    assert e["p"]["source_value"] == 1.0 and e["p"]["target_value"] == 2.0
    assert e["p"]["contribution"] == pytest.approx(0.0 * 0.5) and e["q"]["contribution"] == pytest.approx(1.0)


def test_name_match_literal_and_regex(spark):
    rows = [(1, "A", "Model C++ X", 1.0), (2, "B", "Roadster S", 2.0), (3, "B", "roadster 9", 3.0)]
    df = spark.createDataFrame(rows, "row_id long, Company_Clean string, Car_Name_Clean string, p double")
    rec = similar.Recommender(["p"]).fit(df)
    assert rec.first_match("c++").first()["target_id"] == 1          # literal by default
    assert rec.first_match(r"ROADSTER \S", regex=True).first()["target_id"] == 2
    assert rec.first_match(r"roadster \d", regex=True).first()["target_id"] == 3
    assert rec.first_match("nothing").count() == 0

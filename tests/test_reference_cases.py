"""The reference test suite's cases, re-expressed on Spark (frames built the same way)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsheet.operators.clean import clean_dataset
from specsheet.operators.models import PerformanceClassifier, PricePredictor
from specsheet.operators.similar import Recommender

REG_FEATS = ["HorsePower", "Speed", "Acceleration", "Torque"]


def test_cleaner_on_three_rows(spark):
    df = spark.createDataFrame([(1, "$50,000", "300 hp"), (2, "$30,000 - $40,000", "200-250 hp"),
                                (3, "N/A", None)], "row_id long, cars_prices string, horsepower string")
    raw = df
    for c in ["total_speed", "accel_0_100", "torque", "cc_battery", "seats", "fuel_types", "company_names",
              "cars_names"]:
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    out = {r["row_id"]: r for r in clean_dataset(raw).collect()}
    assert out[1]["Price_USD"] == 50000 and out[2]["Price_USD"] == 35000 and out[3]["Price_USD"] is None
    assert out[2]["HorsePower_Numeric"] == 225


@pytest.fixture(scope="module")
def reg_frame(spark):
    rng = np.random.default_rng(42)
    n = 100
    x = np.column_stack([rng.uniform(100, 800, n), rng.uniform(150, 350, n), rng.uniform(2, 12, n),
                         rng.uniform(150, 900, n)])
    y = rng.uniform(20000, 500000, n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in REG_FEATS) + ", price double")


def test_price_predictor_basics(reg_frame):
    pp = PricePredictor(REG_FEATS, fast=True)
    pp.train(reg_frame, "price")
    assert pp.is_fitted
    preds = pp.predict(reg_frame.limit(5)).select("prediction").collect()
    assert len(preds) == 5 and all(r[0] > 0 for r in preds)
    assert pp.feature_importance().count() == 4


def test_regression_quality_on_learnable_target(spark):
    rng = np.random.default_rng(1)
    n = 1500
    hp, sp, acc = rng.uniform(100, 800, n), rng.uniform(150, 350, n), rng.uniform(2, 12, n)
    y = 400 * hp + 200 * sp - 3000 * acc + 0.5 * hp * np.sqrt(sp) + rng.normal(0, 8000, n)
    df = spark.createDataFrame([(i, float(hp[i]), float(sp[i]), float(acc[i]), float(y[i])) for i in range(n)],
                               "row_id long, hp double, sp double, acc double, y double")
    pp = PricePredictor(["hp", "sp", "acc"], fast=True)
    res = pp.train(df, "y")
    best = res.where((F.col("model") == pp.best_model_name) & (F.col("split") == "validation")).first()
    assert best["r2"] > 0.8


def test_classifier_basics(spark):
    rng = np.random.default_rng(42)
    n = 100
    x = np.column_stack([rng.uniform(100, 800, n), rng.uniform(150, 350, n), rng.uniform(150, 900, n)])
    labels = np.array(["High-Performance", "Mid-Range", "Economy"])[rng.integers(0, 3, n)]
    rows = [(i, *map(float, x[i]), str(labels[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, HorsePower double, Speed double, Torque double, cls string")
    pc = PerformanceClassifier(["HorsePower", "Speed", "Torque"], fast=True)
    pc.train(df, "cls")
    assert set(r[0] for r in pc.predict(df).select("predicted_class").distinct().collect()) <= set(labels)
    pr = pc.predict_proba(df.limit(10))
    tot = pr.select(sum(F.col(f"`proba_{c}`") for c in pc.labels).alias("t")).collect()
    assert all(round(r["t"], 3) == 1.0 for r in tot)


@pytest.fixture(scope="module")
def rec_frame(spark):
    rng = np.random.default_rng(42)
    cols = ["HorsePower_Numeric", "Speed_KMH", "Acceleration_Sec", "Torque_Nm", "CC_Numeric", "Seats_Numeric",
            "Price_USD"]
    vals = np.column_stack([rng.uniform(100, 800, 50), rng.uniform(150, 350, 50), rng.uniform(2, 12, 50),
                            rng.uniform(150, 900, 50), rng.uniform(1000, 6000, 50), rng.integers(2, 8, 50),
                            rng.uniform(20000, 500000, 50)])
    rows = [(i, "BRAND_A" if i < 25 else "BRAND_B", f"Car_{i}", *map(float, vals[i])) for i in range(50)]
    return spark.createDataFrame(rows, "row_id long, Company_Clean string, Car_Name_Clean string, "
                                 + ", ".join(f"{c} double" for c in cols))


def test_recommender_invariants(rec_frame):
    rec = Recommender().fit(rec_frame)
    out = rec.similar([0], n=5).collect()
    assert len(out) == 5 and all(r["similarity_score"] <= 1 for r in out)
    assert all(r["row_id"] != 0 for r in out)
    other = rec.similar([0], n=5, exclude_same_brand=True).collect()
    assert all(r["Company_Clean"] != "BRAND_A" for r in other)
    cov = rec.coverage().first()[0]
    assert 0 <= cov <= 1
    assert rec.similar_by_name("car_1", 3).count() == 3
    assert rec.similar_by_specs({"HorsePower_Numeric": 500, "Price_USD": 100000}, 5).count() == 5
    with pytest.raises(ValueError):
        Recommender().similar([0])

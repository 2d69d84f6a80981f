"""Model sanity: fit flags, shapes, probabilities, persistence, metrics (small ensembles)."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from specsheet.operators.clean import PRICE
from specsheet.operators.features import MODEL_NUMERIC, PERF_CATEGORY
from specsheet.operators.models import PerformanceClassifier, PricePredictor
from specsheet.plans.pipeline import specs


@pytest.fixture(scope="module")
def frame(spark):
    return specs(spark, SF01).dropna(subset=[*MODEL_NUMERIC, PRICE]).cache()


@pytest.fixture(scope="module")
def reg(frame):
    pp = PricePredictor(fast=True)
    res = pp.train(frame, PRICE)
    return pp, res


@pytest.fixture(scope="module")
def clf(frame):
    pc = PerformanceClassifier(fast=True)
    res = pc.train(frame.where(F.col(PERF_CATEGORY) != "Unknown"), PERF_CATEGORY)
    return pc, res


def test_regressor_trains_all(reg):
    pp, res = reg
    assert pp.is_fitted and pp.best_model_name in pp.models
    ok = res.where("status = 'success'").select("model").distinct().count()
    assert ok == 3
    assert res.where("split = 'validation'").count() == 3


def test_regressor_predict_and_importance(reg, frame):
    pp, _ = reg
    p = pp.predict(frame.limit(5)).select("prediction").collect()
    assert len(p) == 5 and all(r[0] is not None for r in p)
    imp = pp.feature_importance().collect()
    assert len(imp) == len(MODEL_NUMERIC)


def test_unfitted_raises(frame):
    with pytest.raises(ValueError):
        PricePredictor(fast=True).predict(frame)


def test_save_load_identical(reg, frame, spark, tmp_path):
    pp, _ = reg
    path = str(tmp_path / "m")
    pp.save_model(path)
    loaded = PricePredictor.load_model(path)
    a = pp.predict(frame).select("row_id", F.col("prediction").alias("a"))
    b = loaded.predict(frame).select("row_id", F.col("prediction").alias("b"))
    assert a.join(b, "row_id").where("a != b").count() == 0


def test_classifier_labels_and_probabilities(clf, frame):
    pc, res = clf
    assert pc.labels == sorted(pc.labels)
    rows = frame.where(F.col(PERF_CATEGORY) != "Unknown").limit(50)
    pred = pc.predict(rows).select("predicted_class").distinct().collect()
    assert {r[0] for r in pred} <= set(pc.labels)
    for name in pc.models:
        pr = pc.predict_proba(rows, name)
        tot = pr.select(sum(F.col(f"`proba_{c}`") for c in pc.labels).alias("t")).collect()
        assert all(abs(r["t"] - 1) < 1e-3 for r in tot)


def test_classifier_report(clf, frame):
    pc, _ = clf
    rows = frame.where(F.col(PERF_CATEGORY) != "Unknown")
    cm = pc.confusion_matrix(rows, PERF_CATEGORY)
    assert cm.count() == 9
    assert cm.agg(F.sum("count")).first()[0] == rows.count()
    rep = pc.classification_report(rows, PERF_CATEGORY)
    assert rep.where("label = 'accuracy'").count() == 1


def test_cross_validation_shapes(frame):
    from pyspark.ml.regression import LinearRegression

    pp = PricePredictor(candidates={"ridge": LinearRegression(solver="normal")})
    cv = pp.cross_validate(frame, PRICE, 5)
    assert cv.count() == 5 and cv.where("r2 IS NULL").count() == 0

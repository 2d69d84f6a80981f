"""Registered model, attribution and pipeline queries.

Fitting is iterative and has no SQL twin, so most of these get the rows-only check; the
closed-form ones (two-feature ridge, linear attributions) carry SQL. Fitted models are kept per
(session, scale-factor dir) so the queries share one training run.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..operators import charts, explain as E, explore
from ..operators.clean import ACCEL, HP, PRICE, SPEED, TORQUE
from ..operators.boosting import SoftmaxBoosting
from ..operators.features import CATEGORIES, MODEL_NUMERIC, PERF_CATEGORY, UNKNOWN, impute_median
from ..operators.models import PerformanceClassifier, PricePredictor, cv_summary, regression_candidates, side_by_side
from ..session import ensure_checkpoint_dir, materialize
from . import oracle as O
from .pipeline import specs
from .queries import r, register

_FITTED: dict = {}


def model_df(spark, sf_dir):
    """Rows with every model feature and the price present (the reference's modelling frame)."""
    return specs(spark, sf_dir).dropna(subset=[*MODEL_NUMERIC, PRICE])


def class_df(spark, sf_dir):
    return model_df(spark, sf_dir).where(F.col(PERF_CATEGORY) != UNKNOWN)


def _key(spark, sf_dir, what):
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)


def regressor(spark, sf_dir) -> tuple[PricePredictor, object]:
    k = _key(spark, sf_dir, "reg")
    if k not in _FITTED:
        pp = PricePredictor()
        res = pp.train(model_df(spark, sf_dir), PRICE).cache()
        _FITTED[k] = (pp, res)
    return _FITTED[k]


def classifier(spark, sf_dir) -> tuple[PerformanceClassifier, object]:
    k = _key(spark, sf_dir, "clf")
    if k not in _FITTED:
        pc = PerformanceClassifier()
        res = pc.train(class_df(spark, sf_dir), PERF_CATEGORY).cache()
        _FITTED[k] = (pc, res)
    return _FITTED[k]


def gbt_regressor(spark, sf_dir) -> PricePredictor:
    """The boosted regression candidate on all modelling rows (the one the attributions explain)."""
    k = _key(spark, sf_dir, "gbt")
    if k not in _FITTED:
        pp = PricePredictor(candidates={"gradient_boosting": regression_candidates()["gradient_boosting"]})
        pp.train(model_df(spark, sf_dir), PRICE, validate=False)
        _FITTED[k] = pp
    return _FITTED[k]


# ================================================================ regression


@register("reg_train")
def q_reg_train(spark, sf_dir):
    return regressor(spark, sf_dir)[1]


@register("reg_predict")
def q_reg_predict(spark, sf_dir):
    pp, _ = regressor(spark, sf_dir)
    return pp.predict(model_df(spark, sf_dir)).select("row_id", PRICE, "prediction")


@register("reg_importance")
def q_reg_importance(spark, sf_dir):
    pp, _ = regressor(spark, sf_dir)
    return pp.feature_importance()


@register("importance_topn")
def q_importance_topn(spark, sf_dir):
    pp, _ = regressor(spark, sf_dir)
    return charts.top_importance(pp.feature_importance("random_forest"), 10)


@register("reg_cv")
def q_reg_cv(spark, sf_dir):
    cv = PricePredictor().cross_validate(model_df(spark, sf_dir), PRICE, 5)
    return cv.join(cv_summary(cv), "model", "left")


_RIDGE = [HP, TORQUE]


@register("reg_ridge", O.with_specs(
    "SELECT term, round(value, 4) AS value FROM (SELECT "
    "((s22 + 1) * sy1 - s12 * sy2) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS w1, "
    "((s11 + 1) * sy2 - s12 * sy1) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS w2, m1, m2, my FROM "
    "(SELECT sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x2 - m2) * (x2 - m2)) AS s22, "
    "sum((x1 - m1) * (y - my)) AS sy1, sum((x2 - m2) * (y - my)) AS sy2, any_value(m1) AS m1, any_value(m2) AS m2, "
    "any_value(my) AS my FROM (SELECT *, avg(x1) OVER () AS m1, avg(x2) OVER () AS m2, avg(y) OVER () AS my FROM "
    f"(SELECT {HP} AS x1, {TORQUE} AS x2, {PRICE} AS y FROM specs WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in [*MODEL_NUMERIC, PRICE]) + ")))) "
    "CROSS JOIN LATERAL (VALUES ('intercept', my - w1 * m1 - w2 * m2), ('" + HP + "', w1), ('" + TORQUE + "', w2)) v(term, value)"))
def q_reg_ridge(spark, sf_dir):
    """Ridge (alpha = 1) on two features: Spark's normal-equation solver with the penalty scaled
    to match the closed form."""
    pp = PricePredictor(_RIDGE, candidates={"ridge": LinearRegression(elasticNetParam=0.0, standardization=False,
                                                                      solver="normal")})
    pp.train(model_df(spark, sf_dir), PRICE, validate=False)
    lr = pp.models["ridge"].stages[-1]
    rows = [("intercept", float(lr.intercept))] + list(zip(_RIDGE, [float(v) for v in lr.coefficients.toArray()]))
    return spark.createDataFrame(rows, "term string, value double").select("term", r("value", 4))


def _ridge_cv_sql() -> str:
    """Leave-one-fold-out ridge (alpha = 1) on two features: sums per fold, less the fold's own."""
    rows = " AND ".join(f"{c} IS NOT NULL" for c in [*MODEL_NUMERIC, PRICE])
    sums = ["n", "a", "b", "y", "aa", "ab", "bb", "ay", "by"]
    return O.with_specs(
        "SELECT CAST(fold AS INTEGER) AS fold, round(1 - sse / spread, 6) AS r2 FROM (SELECT r.fold, "
        "sum((r.y - (my + w1 * (r.a - ma) + w2 * (r.b - mb))) ** 2) AS sse, var_pop(r.y) * count(*) AS spread FROM r JOIN w USING (fold) GROUP BY r.fold)",
        f"p AS (SELECT {HP} AS a, {TORQUE} AS b, {PRICE} AS y, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM specs WHERE {rows}), "
        "r AS (SELECT a - (SELECT avg(a) FROM p) AS a, b - (SELECT avg(b) FROM p) AS b, y - (SELECT avg(y) FROM p) AS y, "
        "CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM p), "
        "f AS (SELECT fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, "
        "sum(b*y) AS \"by\" FROM r GROUP BY fold), "
        "t AS (SELECT h.fold, " + ", ".join(f"sum(o.\"{c}\") AS \"{c}\"" for c in sums) + " FROM f h JOIN f o ON o.fold <> h.fold GROUP BY h.fold), "
        "c AS (SELECT fold, a / n AS ma, b / n AS mb, y / n AS my, aa - a * a / n AS s11, ab - a * b / n AS s12, bb - b * b / n AS s22, "
        "ay - a * y / n AS s1, \"by\" - b * y / n AS s2 FROM t), "
        "w AS (SELECT fold, ma, mb, my, ((s22 + 1) * s1 - s12 * s2) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS w1, "
        "((s11 + 1) * s2 - s12 * s1) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS w2 FROM c)")


@register("reg_cv_ridge", _ridge_cv_sql())
def q_reg_cv_ridge(spark, sf_dir):
    """R^2 per contiguous fold of the ridge candidate on two features, every fold from one pass."""
    ridge = {"ridge": regression_candidates()["ridge"]}
    cv = PricePredictor(_RIDGE, candidates=ridge).cross_validate(model_df(spark, sf_dir), PRICE, 5)
    return cv.select("fold", r("r2"))


# ================================================================ classification


@register("clf_train")
def q_clf_train(spark, sf_dir):
    return classifier(spark, sf_dir)[1]


@register("clf_predict")
def q_clf_predict(spark, sf_dir):
    pc, _ = classifier(spark, sf_dir)
    return pc.predict(class_df(spark, sf_dir)).select("row_id", PERF_CATEGORY, "predicted_class")


@register("clf_proba")
def q_clf_proba(spark, sf_dir):
    pc, _ = classifier(spark, sf_dir)
    out = pc.predict_proba(class_df(spark, sf_dir))
    return out.select("row_id", *[c for c in out.columns if c.startswith("proba_")])


@register("clf_importance")
def q_clf_importance(spark, sf_dir):
    pc, _ = classifier(spark, sf_dir)
    return pc.feature_importance()


@register("clf_confusion")
def q_clf_confusion(spark, sf_dir):
    pc, _ = classifier(spark, sf_dir)
    return pc.confusion_matrix(class_df(spark, sf_dir), PERF_CATEGORY)


@register("clf_report_model")
def q_clf_report_model(spark, sf_dir):
    pc, _ = classifier(spark, sf_dir)
    return pc.classification_report(class_df(spark, sf_dir), PERF_CATEGORY)


@register("clf_cv")
def q_clf_cv(spark, sf_dir):
    cv = PerformanceClassifier().cross_validate(class_df(spark, sf_dir), PERF_CATEGORY, 5)
    return cv.join(cv_summary(cv, "f1"), "model", "left")


@register("what_if")
def q_what_if(spark, sf_dir):
    """Every spec row scored for price and category by the fitted models, which are trained at the same time."""
    rows = specs(spark, sf_dir).select("row_id", *MODEL_NUMERIC)
    (pp, _), (pc, _) = side_by_side(lambda: regressor(spark, sf_dir), lambda: classifier(spark, sf_dir))
    return explore.what_if(pp, pc, rows).select("row_id", "predicted_price", "predicted_category")


_MODEL_ROWS = " AND ".join(f"{c} IS NOT NULL" for c in [*MODEL_NUMERIC, PRICE])
_CLASS_ROWS = f"{_MODEL_ROWS} AND {PERF_CATEGORY} <> '{UNKNOWN}'"


@register("model_roundtrip", O.with_specs(f"SELECT row_id, true AS equal FROM specs WHERE {_MODEL_ROWS}"))
def q_model_roundtrip(spark, sf_dir):
    """Save the best regressor, load it back, and compare predictions row by row."""
    pp, _ = regressor(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    pp.save_model(path)
    loaded = PricePredictor.load_model(path)
    rows = model_df(spark, sf_dir)
    a = pp.predict(rows).select("row_id", F.col("prediction").alias("before"))
    b = loaded.predict(rows).select("row_id", F.col("prediction").alias("after"))
    return a.join(b, "row_id").select("row_id", (F.col("before") == F.col("after")).alias("equal"))


def _priced(name):
    """Each modelling row is priced by one regression candidate, with a finite number."""
    def query(spark, sf_dir):
        pp, _ = regressor(spark, sf_dir)
        got = F.col("prediction")
        finite = got.isNotNull() & ~F.isnan(got) & (F.abs(got) < float("inf"))
        return pp.predict(model_df(spark, sf_dir), name).select("row_id", finite.alias("finite"))
    return query


for _query, _name in (("reg_rf", "random_forest"), ("reg_gbt", "gradient_boosting"), ("reg_ridge_model", "ridge")):
    register(_query, O.with_specs(f"SELECT row_id, true AS finite FROM specs WHERE {_MODEL_ROWS}"))(_priced(_name))


def _classified(name):
    """Each modelling row gets a known class from one candidate, and probabilities that sum to 1."""
    def query(spark, sf_dir):
        pc, _ = classifier(spark, sf_dir)
        rows = pc.predict(pc.predict_proba(class_df(spark, sf_dir), name), name)
        total = sum((F.col(f"proba_{label}") for label in pc.labels), F.lit(0.0))
        return rows.select("row_id", F.col("predicted_class").isin(list(pc.labels)).alias("known"), F.round(total, 6).alias("total"))
    return query


for _query, _name in (("clf_rf", "random_forest"), ("clf_gbt", "gradient_boosting"), ("clf_logit", "logistic_regression")):
    register(_query, O.with_specs(
        f"SELECT row_id, true AS known, 1.0::DOUBLE AS total FROM specs WHERE {_CLASS_ROWS}"))(_classified(_name))


@register("clf_softmax", O.with_specs(f"SELECT row_id, true AS known, 1.0::DOUBLE AS total FROM specs WHERE {_CLASS_ROWS}"))
def q_clf_softmax(spark, sf_dir):
    """Classes and probabilities of one multiclass boosting model (a tree per class and round)."""
    rows = class_df(spark, sf_dir)
    codes = F.array(*[F.lit(c) for c in CATEGORIES])
    label = F.nullif(F.array_position(codes, F.col(PERF_CATEGORY)), F.lit(0)) - 1
    model = SoftmaxBoosting(MODEL_NUMERIC, rounds=30, depth=4, step=0.2).fit(rows.withColumn("label", label), "label", len(CATEGORIES))
    out = model.transform(rows)
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    return out.select("row_id", F.get(codes, F.col("prediction").cast("int")).isNotNull().alias("known"), F.round(total, 6).alias("total"))


@register("what_if_rows", O.with_specs("SELECT row_id, true AS priced, true AS labelled FROM specs"))
def q_what_if_rows(spark, sf_dir):
    """Every spec row gets a price and a category, missing features or not."""
    out = q_what_if(spark, sf_dir)
    return out.select("row_id", F.col("predicted_price").isNotNull().alias("priced"),
                      F.col("predicted_category").isNotNull().alias("labelled"))


# ================================================================ attributions


def _phi(spark, sf_dir):
    k = _key(spark, sf_dir, "phi")
    if k not in _FITTED:
        pp = gbt_regressor(spark, sf_dir)
        rows = impute_median(model_df(spark, sf_dir), MODEL_NUMERIC, _medians_row(spark, pp))
        # Checkpointed once: every attribution summary reads the same values.
        _FITTED[k] = materialize(E.tree_shap(rows, pp.models["gradient_boosting"], MODEL_NUMERIC))
    return _FITTED[k]


def _medians_row(spark, pp):
    return spark.createDataFrame([tuple(pp.medians.get(c) for c in MODEL_NUMERIC)],
                                 ", ".join(f"`{c}` double" for c in MODEL_NUMERIC))


@register("shap_tree")
def q_shap_tree(spark, sf_dir):
    return _phi(spark, sf_dir)


@register("shap_tree_sum", O.with_specs(f"SELECT row_id, true AS adds_up FROM specs WHERE {_MODEL_ROWS}"))
def q_shap_tree_sum(spark, sf_dir):
    """Base value plus attributions is the model's prediction."""
    total = _phi(spark, sf_dir).groupBy("row_id").agg((F.first("base_value") + F.sum("shap_value")).alias("total"))
    priced = gbt_regressor(spark, sf_dir).predict(model_df(spark, sf_dir)).select("row_id", "prediction")
    near = F.abs(F.col("total") - F.col("prediction")) <= 1e-6 * (1 + F.abs("prediction"))
    return total.join(priced, "row_id").select("row_id", near.alias("adds_up"))


@register("shap_class_importance")
def q_shap_class_importance(spark, sf_dir):
    """Importance over all classes of the forest classifier."""
    pc, _ = classifier(spark, sf_dir)
    phi = E.class_shap(class_df(spark, sf_dir), pc.models["random_forest"], MODEL_NUMERIC)
    return E.shap_importance(phi, by_class=True)


@register("shap_importance")
def q_shap_importance(spark, sf_dir):
    return E.shap_importance(_phi(spark, sf_dir))


@register("explain_row")
def q_explain_row(spark, sf_dir):
    rows = impute_median(model_df(spark, sf_dir), MODEL_NUMERIC, _medians_row(spark, gbt_regressor(spark, sf_dir)))
    return E.explain_rows(_phi(spark, sf_dir), values=rows.select("row_id", *MODEL_NUMERIC))


@register("explain_text")
def q_explain_text(spark, sf_dir):
    return E.explanation_text(E.explain_rows(_phi(spark, sf_dir)))


@register("importance_norm")
def q_importance_norm(spark, sf_dir):
    return E.importance_normalized(gbt_regressor(spark, sf_dir).feature_importance())


@register("shap_summary")
def q_shap_summary(spark, sf_dir):
    return E.shap_summary(_phi(spark, sf_dir), kind="bar", max_display=10)


@register("shap_dependence")
def q_shap_dependence(spark, sf_dir):
    return E.shap_dependence(_phi(spark, sf_dir), model_df(spark, sf_dir), HP, SPEED)


@register("shap_force")
def q_shap_force(spark, sf_dir):
    return E.shap_force(_phi(spark, sf_dir))


# Fixed weights for the linear attribution query (a linear model given as coefficients).
_LIN_W = {HP: 100.0, SPEED: -50.0, ACCEL: 2000.0}


@register("shap_linear", O.with_specs(
    "SELECT row_id, feature, round(shap_value, 6) AS shap_value, round(base_value, 6) AS base_value FROM "
    "(SELECT row_id, " + ", ".join(f"{w!r} * ({c} - m_{i}) AS p{i}" for i, (c, w) in enumerate(_LIN_W.items()))
    + ", " + " + ".join(f"{w!r} * m_{i}" for i, (c, w) in enumerate(_LIN_W.items())) + " AS base_value FROM specs, "
    "(SELECT " + ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(_LIN_W)) + " FROM specs)) "
    "CROSS JOIN LATERAL (VALUES " + ", ".join(f"('{c}', p{i})" for i, c in enumerate(_LIN_W)) + ") v(feature, shap_value)"))
def q_shap_linear(spark, sf_dir):
    rows = specs(spark, sf_dir)
    phi = E.linear_shap(rows, _LIN_W, rows)
    return phi.select("row_id", "feature", r("shap_value"), r("base_value"))


_LIN_CTE = (
    "means AS (SELECT " + ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(_LIN_W)) + " FROM specs), "
    "phi AS (SELECT row_id, feature, value, shap_value, base_value FROM (SELECT row_id, "
    + ", ".join(f"{c}::DOUBLE AS x{i}, {w!r} * ({c} - m_{i}) AS p{i}" for i, (c, w) in enumerate(_LIN_W.items())) + ", "
    + " + ".join(f"{w!r} * m_{i}" for i, w in enumerate(_LIN_W.values())) + " AS base_value FROM specs, means WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LIN_W) + ") CROSS JOIN LATERAL (VALUES "
    + ", ".join(f"('{c}', x{i}, p{i})" for i, c in enumerate(_LIN_W)) + ") v(feature, value, shap_value))")


def _linear_phi(spark, sf_dir):
    """Linear attributions of the rows whose features are complete, and these rows."""
    all_rows = specs(spark, sf_dir)
    rows = all_rows.dropna(subset=list(_LIN_W)).select("row_id", *_LIN_W)
    return E.linear_shap(rows, _LIN_W, all_rows), rows


@register("shap_importance_linear", O.with_specs(
    "SELECT feature, round(avg(abs(shap_value)), 4) AS importance, round(stddev_pop(abs(shap_value)), 4) AS std "
    "FROM phi GROUP BY feature", _LIN_CTE))
def q_shap_importance_linear(spark, sf_dir):
    return E.shap_importance(_linear_phi(spark, sf_dir)[0]).select("feature", r("importance", 4), r("std", 4))


@register("shap_summary_linear", O.with_specs(
    "SELECT row_id, feature, round(shap_value, 4) AS shap_value, value AS feature_value FROM phi WHERE feature IN "
    "(SELECT feature FROM phi GROUP BY feature ORDER BY avg(abs(shap_value)) DESC, feature LIMIT 2)", _LIN_CTE))
def q_shap_summary_linear(spark, sf_dir):
    """The dots of the two most important features."""
    phi, rows = _linear_phi(spark, sf_dir)
    out = E.shap_summary(phi, rows, kind="dot", max_display=2)
    return out.select("row_id", "feature", r("shap_value", 4), "feature_value")


@register("shap_dependence_linear", O.with_specs(
    f"SELECT p.row_id, round(p.shap_value, 4) AS shap_value, p.value AS feature_value, q.value AS interaction_value "
    f"FROM phi p JOIN phi q ON p.row_id = q.row_id AND q.feature = '{SPEED}' WHERE p.feature = '{HP}'", _LIN_CTE))
def q_shap_dependence_linear(spark, sf_dir):
    phi, rows = _linear_phi(spark, sf_dir)
    return E.shap_dependence(phi, rows, HP, SPEED).select("row_id", r("shap_value", 4), "feature_value", "interaction_value")


@register("shap_force_linear", O.with_specs(
    "SELECT row_id, feature, round(shap_value, 4) AS shap_value, round(base_value + sum(shap_value) OVER w, 4) AS cumulative, "
    "(row_number() OVER w)::INTEGER AS \"order\" FROM phi "
    "WINDOW w AS (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature ROWS UNBOUNDED PRECEDING)", _LIN_CTE))
def q_shap_force_linear(spark, sf_dir):
    phi, _ = _linear_phi(spark, sf_dir)
    return E.shap_force(phi).select("row_id", "feature", r("shap_value", 4), r("cumulative", 4), "order")


@register("explain_row_linear", O.with_specs(
    "SELECT row_id, round(any_value(base_value) + sum(shap_value), 4) AS prediction, "
    "arg_max(feature, abs(shap_value)) AS strongest, arg_max(value, abs(shap_value)) AS strongest_value, "
    "count(*) FILTER (WHERE shap_value > 0)::INTEGER AS n_raising, count(*) FILTER (WHERE shap_value < 0)::INTEGER AS n_lowering "
    "FROM phi GROUP BY row_id", _LIN_CTE))
def q_explain_row_linear(spark, sf_dir):
    phi, rows = _linear_phi(spark, sf_dir)
    first = F.get("contributions", 0)
    return E.explain_rows(phi, values=rows).select(
        "row_id", r("prediction", 4), first["feature"].alias("strongest"), first["value"].alias("strongest_value"),
        F.size("top_positive").alias("n_raising"), F.size("top_negative").alias("n_lowering"))


@register("shap_any_linear", O.with_specs(
    "SELECT row_id, feature, round(shap_value, 4) AS shap_value FROM (SELECT row_id, "
    + ", ".join(f"{w!r} * ({c} - m_{i}) AS p{i}" for i, (c, w) in enumerate(_LIN_W.items())) + " FROM specs, (SELECT "
    + ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(_LIN_W)) + " FROM (SELECT * FROM specs WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LIN_W) + " ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 100)) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LIN_W) + ") CROSS JOIN LATERAL (VALUES "
    + ", ".join(f"('{c}', p{i})" for i, c in enumerate(_LIN_W)) + ") v(feature, shap_value)"))
def q_shap_any_linear(spark, sf_dir):
    """Exact enumeration for a model given as an expression; a linear one has a closed form. The
    background is a seeded sample of 100 complete rows."""
    rows = _linear_phi(spark, sf_dir)[1]
    model = SQLTransformer(statement="SELECT *, " + " + ".join(f"{w!r} * {c}" for c, w in _LIN_W.items())
                           + " AS prediction FROM __THIS__")
    phi = E.exact_shap(rows, model, list(_LIN_W), E.background_sample(rows, 100))
    return phi.select("row_id", "feature", r("shap_value", 4))


@register("shap_kernel_linear", O.with_specs(
    "SELECT row_id, feature, round(shap_value, 4) AS shap_value FROM (SELECT row_id, "
    + ", ".join(f"{w!r} * ({c} - m_{i}) AS p{i}" for i, (c, w) in enumerate(_LIN_W.items())) + " FROM specs, (SELECT "
    + ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(_LIN_W)) + " FROM specs WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LIN_W) + ") WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LIN_W) + ") CROSS JOIN LATERAL (VALUES "
    + ", ".join(f"('{c}', p{i})" for i, c in enumerate(_LIN_W)) + ") v(feature, shap_value)"))
def q_shap_kernel_linear(spark, sf_dir):
    """Kernel-weighted attributions of every row against the mean of all rows; a linear model has a closed form."""
    rows = _linear_phi(spark, sf_dir)[1]
    model = SQLTransformer(statement="SELECT *, " + " + ".join(f"{w!r} * {c}" for c, w in _LIN_W.items())
                           + " AS prediction FROM __THIS__")
    phi = E.kernel_shap(rows, model, list(_LIN_W), rows.agg(*[F.avg(c).alias(c) for c in _LIN_W]))
    return phi.select("row_id", "feature", r("shap_value", 4))


@register("shap_any")
def q_shap_any(spark, sf_dir):
    """Exact coalition enumeration for the fitted ridge candidate against a 100-row background."""
    pp, _ = regressor(spark, sf_dir)
    rows = impute_median(model_df(spark, sf_dir), MODEL_NUMERIC, _medians_row(spark, pp))
    bg = E.background_sample(rows, 100)
    return E.exact_shap(rows, pp.models["ridge"], MODEL_NUMERIC, bg)


# ================================================================ pipeline


@register("pipeline_summary")
def q_pipeline_summary(spark, sf_dir):
    from ..sources.fixture import raw_specs
    from .pipeline import run
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    return run(raw_specs(spark, sf_dir), out)

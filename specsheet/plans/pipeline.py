"""PIP-1/2: raw spec sheets -> features -> models -> saved artefacts and a summary.

``build_features`` is lazy (one projection chain over the scan); ``run`` is the batch job: it
checkpoints the feature table once (into the session's shared checkpoint dir), fits the price
and class models, the recommender, writes chart data and models under ``out_dir`` and returns
one summary row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import PRICE, clean_dataset, remove_invalid_rows
from ..operators.features import create_all_features
from ..sources.fixture import raw_specs


def build_features(raw: DataFrame, min_price: float = 1000, max_price: float = 50_000_000) -> DataFrame:
    """clean -> keep valid prices -> derived features; lazy, one projection chain."""
    return create_all_features(remove_invalid_rows(clean_dataset(raw), min_price=min_price, max_price=max_price))


_WRITTEN: dict = {}


def specs(spark: SparkSession, sf_dir: str, written: bool = True) -> DataFrame:
    """The featured spec table for a scale-factor directory (derived from ``part``).

    Parsing free text is the expensive step, and every analysis reads the typed table, so by
    default it is computed once per session and directory and written as parquet under the
    shared checkpoint dir (PIP-1 materialises once, as the reference does in memory). Readers
    then get column pruning and filter pushdown on the typed columns. ``written=False`` returns
    the lazy derivation.
    """
    if not written:
        return build_features(raw_specs(spark, sf_dir))
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _WRITTEN:
        import uuid

        from ..session import ensure_checkpoint_dir
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/specs-{uuid.uuid4().hex}"
        build_features(raw_specs(spark, sf_dir)).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def run(raw: DataFrame, out_dir: str, fast: bool = False) -> DataFrame:
    """The whole batch pipeline; returns ``(rows, valid_rows, best_regressor, best_r2,
    best_classifier, best_f1, coverage, charts_written)``."""
    from ..operators.features import MODEL_NUMERIC, PERF_CATEGORY, UNKNOWN
    from ..operators.models import PerformanceClassifier, PricePredictor, side_by_side
    from ..operators.similar import Recommender
    from ..session import materialize
    from ..sinks.charts import write_chart_data

    spark = raw.sparkSession
    feats = materialize(build_features(raw))
    counts = raw.agg(F.count(F.lit(1)).alias("rows")).crossJoin(feats.agg(F.count(F.lit(1)).alias("valid_rows")))
    model_rows = feats.dropna(subset=[*MODEL_NUMERIC, PRICE])
    pp, pc = PricePredictor(fast=fast), PerformanceClassifier(fast=fast)
    reg, clf = side_by_side(lambda: pp.train(model_rows, PRICE),
                            lambda: pc.train(model_rows.where(F.col(PERF_CATEGORY) != UNKNOWN), PERF_CATEGORY))
    rec = Recommender().fit(feats)
    written = write_chart_data(feats, f"{out_dir.rstrip('/')}/charts")
    pp.save_model(f"{out_dir.rstrip('/')}/models/price_predictor")
    pc.save_model(f"{out_dir.rstrip('/')}/models/performance_classifier")
    best_r2 = reg.where((F.col("model") == pp.best_model_name) & (F.col("split") == "validation")).select("r2")
    best_f1 = clf.where((F.col("model") == pc.best_model_name) & (F.col("split") == "validation")).select(
        F.col("f1_weighted").alias("f1"))
    return counts.crossJoin(best_r2).crossJoin(best_f1).crossJoin(rec.coverage()).select(
        "rows", "valid_rows", F.lit(pp.best_model_name).alias("best_regressor"), "r2",
        F.lit(pc.best_model_name).alias("best_classifier"), "f1", "coverage",
        F.lit(len(written)).alias("charts_written"))

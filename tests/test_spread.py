"""Rows of a table that is one row group go to several tasks; the rows are the same."""

import re

from pyspark.sql import functions as F

from specsheet.operators.models import fit_partitions
from specsheet.operators.quality import column_summary
from specsheet.plans.pipeline import specs
from specsheet.sources.fixture import raw_specs, raw_specs_from_part
from specsheet.sources.tables import ROWS_A_TASK, spread


def _part(spark, path, n):
    part = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 7).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 9).alias("p_brand"),
        F.lit("SMALL").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{path}/part.parquet")
    return spark.read.parquet(f"{path}/part.parquet")


def test_one_row_group_becomes_several_tasks(spark, tmp_path):
    part = _part(spark, str(tmp_path), 2 * ROWS_A_TASK + 5)
    raw = raw_specs(spark, str(tmp_path))
    sizes = [r["count"] for r in raw.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) <= ROWS_A_TASK
    assert raw.exceptAll(raw_specs_from_part(part)).count() == 0 and raw.count() == 2 * ROWS_A_TASK + 5
    written = specs(spark, str(tmp_path))
    assert len(written.inputFiles()) == 3


def test_few_rows_stay(spark):
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_column_summary_holds_no_column_in_a_task(spark):
    rows = spark.createDataFrame([(3, "a", None), (1, None, "x"), (2, "a", "y"), (None, "b", None)], "row_id long, u string, v string")
    out = column_summary(rows)
    got = {r["column"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"row_id": ("bigint", 3, 1, 25.0, 3, "1"), "u": ("string", 3, 1, 25.0, 2, None), "v": ("string", 2, 2, 50.0, 2, "x")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortAggregate\(key=\[\w", plan)
    assert column_summary(rows.limit(0)).count() == 0


def test_fits_have_a_partition_a_core_at_most(spark):
    cores = spark.sparkContext.defaultParallelism
    assert fit_partitions(spark.range(0, 1000, 1, 5 * cores)).rdd.getNumPartitions() == cores
    assert fit_partitions(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 1


def test_fits_start_from_these_partitions(spark, monkeypatch):
    from specsheet.operators import models

    seen = []
    monkeypatch.setattr(models, "Pipeline", lambda stages: type("Fit", (), {"fit": lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or 1 / 0})())
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 300, 1, 3 * cores).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"),
                                                    F.when(F.col("id") % 2 == 0, "x").otherwise("z").alias("k"))
    models.PricePredictor(["a"], fast=True).train(rows, "y")
    models.PricePredictor(["a"], fast=True).cross_validate(rows, "y", 2)
    models.PerformanceClassifier(["a"], fast=True).train(rows, "k")
    models.PerformanceClassifier(["a"], fast=True).cross_validate(rows, "k", 2)
    assert len(seen) == 3 + 4 + 3 + 6 and max(seen) <= cores
    assert models.regression_candidates()["random_forest"].getCacheNodeIds()


def test_many_training_rows_lie_by_their_features(spark):
    from specsheet.operators.models import near_rows

    rows = spark.range(0, 2 * ROWS_A_TASK + 5, 1, 3).select(
        F.col("id").alias("row_id"), *[F.when(F.col("id") % 101 > 0, F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).cast("double")).alias(c) for c in "ab"])
    out = near_rows(rows, ["a", "b"], "row_id")
    assert out.columns == rows.columns and out.exceptAll(rows).count() == 0 and out.count() == rows.count()
    assert out.rdd.getNumPartitions() == 3
    cells = lambda df: df.select(F.spark_partition_id().alias("p"), F.floor(F.col("a") / 125), F.floor(F.col("b") / 125))

    def steps(df):
        got = cells(df).collect()
        return sum(x != y for x, y in zip(got, got[1:]))

    assert steps(out) < steps(rows) / 5
    few = rows.limit(50)
    assert near_rows(few, ["a", "b"], "row_id") is few


def test_fits_at_once_share_the_cores(spark, monkeypatch):
    from specsheet.operators import models

    seen = []
    monkeypatch.setattr(models, "Pipeline", lambda stages: type("Fit", (), {"fit": lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or 1 / 0})())
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "ROWS_A_TASK", 20)
    rows = spark.range(0, 40 * cores, 1, 3).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"),
                                                   F.when(F.col("id") % 2 == 0, "x").otherwise("z").alias("k"))
    models.PricePredictor(["a"], fast=True).cross_validate(rows, "y", 2)
    models.PerformanceClassifier(["a"], fast=True).cross_validate(rows, "k", 2)
    assert len(seen) == 4 + 6 and max(seen) == -(-cores // 2)
    seen.clear()
    models.PricePredictor(["a"], fast=True).train(rows, "y")
    assert max(seen) == cores


def test_both_models_of_what_if_train_at_once(spark, tmp_path, monkeypatch):
    import threading

    from specsheet.plans import ml_queries

    both = threading.Barrier(2, timeout=20)  # passes only if the other training has begun
    _part(spark, str(tmp_path), 40)
    monkeypatch.setattr(ml_queries, "regressor", lambda *a: both.wait() * 0 or ("price", None))
    monkeypatch.setattr(ml_queries, "classifier", lambda *a: both.wait() * 0 or ("class", None))
    seen = []
    monkeypatch.setattr(ml_queries.explore, "what_if", lambda pp, pc, rows: seen.append((pp, pc)) or rows.select("row_id", F.lit(1.0).alias("predicted_price"), F.lit("x").alias("predicted_category")))
    assert ml_queries.q_what_if_rows(spark, str(tmp_path)).where("priced AND labelled").count() > 0 and seen == [("price", "class")]

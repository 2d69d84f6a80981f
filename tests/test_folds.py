"""Folds and label codes keep every row, however the result is forced."""

import tempfile

import pytest
from pyspark.sql import functions as F

from specsheet.operators.features import label_mapping
from specsheet.operators.metrics import contiguous_folds
from specsheet.plans.queries import QUERIES

N = 200_003


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_folds_keep_all_rows(spark, coalescing):
    wide = spark.range(N).select(F.col("id").alias("row_id"), *[F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 256).alias(f"c{i}") for i in range(4)])
    folds = contiguous_folds(wide.repartition(7), 5)
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/folds"
    folds.write.parquet(path)
    cached = folds.cache()
    for got in (folds, cached, folds.checkpoint(), spark.read.parquet(path)):
        sizes = sorted((r["fold"], r["n"], r["a"], r["b"]) for r in got.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).collect())
        assert [s[:2] for s in sizes] == [(0, 40001), (1, 40001), (2, 40001), (3, 40000), (4, 40000)]
        assert [s[2] for s in sizes] == [0, 40001, 80002, 120003, 160003]
    cached.unpersist()


def test_folds_of_few_rows(spark):
    assert contiguous_folds(spark.range(0).withColumnRenamed("id", "row_id"), 5).count() == 0
    got = contiguous_folds(spark.range(3).withColumnRenamed("id", "row_id"), 5).collect()
    assert sorted(r["fold"] for r in got)[0] == 0 and len(got) == 3


def test_label_codes_are_distinct(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(120_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
        codes = label_mapping(df, "v")
        assert codes.count() == 120_000
        assert codes.agg(F.countDistinct("code"), F.min("code"), F.max("code")).first() == (120_000, 0.0, 119_999.0)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("name", ["outlier_rows_events", "zscore_rows_events", "issues_lineitem_keys", "duplicates_lineitem_keys"])
def test_rows_with_hits(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows and (name != "duplicates_lineitem_keys" or rows[0]["duplicates"] > 0)

"""The report's sections against the single operators, and how often it reads its input."""

import pytest
from paths import SF001
from pyspark.sql import functions as F

from specsheet.operators import profile
from specsheet.plans.pipeline import specs


@pytest.fixture(scope="module")
def table(spark):
    return specs(spark, SF001)


def rows(df):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_sections_equal_single_operators(table):
    report = profile.eda_report(table)
    assert rows(report["basic_statistics"]) == rows(profile.basic_statistics(table))
    assert rows(report["price_analysis"]) == rows(profile.price_distribution(table))
    assert rows(report["price_segments"]) == rows(profile.price_segments(table))
    assert rows(report["correlation_matrix"]) == rows(profile.correlation_matrix(table))
    assert rows(report["brand_analysis"]) == rows(profile.by_brand(table))
    assert rows(report["fuel_type_analysis"]) == rows(profile.by_fuel_type(table))
    assert rows(report["performance_price"]) == rows(profile.performance_vs_price(table))
    assert report["dataset_shape"].first()["rows"] == table.count()


def test_input_is_read_six_times(spark, table):
    n, read = table.count(), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    counted = table.repartition(2).mapInPandas(count, table.schema)
    profile.eda_report_long(counted).collect()
    assert 0 < read.value <= 6 * n


def test_optional_columns_and_no_rows(table):
    few = table.drop(profile.MAKER, profile.FUEL, profile.ACCEL)
    assert {"brand_analysis", "fuel_type_analysis", "performance_price"}.isdisjoint(profile.eda_report(few))
    none = profile.eda_report(table.where(F.lit(False)))
    assert none["dataset_shape"].first()["rows"] == 0 and none["brand_analysis"].count() == 0

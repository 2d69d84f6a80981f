"""Pairwise-complete correlations as matrix products, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specsheet.functions.moments import pair_moments
from specsheet.operators.profile import correlation_matrix


def frame(n=3000, d=50, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 1e6 * rng.random(d)
    x[rng.random((n, d)) < 0.15] = np.nan
    x[:, 3] = 7.25
    x[:, 4] = np.nan
    x[2:, 5] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])


def spark_frame(spark, pdf, parts=7):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(parts)


def test_fifty_columns_against_pandas(spark):
    pdf = frame()
    got = {(r["row"], r["col"]): r["corr"] for r in correlation_matrix(spark_frame(spark, pdf), decimals=None).collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 2500
    for a in pdf.columns:
        for b in pdf.columns:
            w = want.loc[a, b]
            if np.isnan(w):
                assert got[a, b] is None, (a, b)
            else:
                assert got[a, b] == pytest.approx(w, abs=1e-9), (a, b)


def method_sizes(spark, make):
    """Bytes of the largest generated method per stage of a plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are generated only as they run
    try:
        codegen = make()._jdf.queryExecution().debug().codegenToSeq()
        return [codegen.apply(i)._3().maxMethodCodeSize() for i in range(codegen.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_code_does_not_grow_with_columns(spark):
    """No method comes near the 8,000 bytes from which generated code is given up."""
    df = spark_frame(spark, frame(50))
    sizes = method_sizes(spark, lambda: pair_moments(df, df.columns, np.zeros(50)))
    assert sizes and max(sizes) < 8000


def test_cleaner_stays_in_generated_code(spark, tmp_path):
    """The table cleaner over a table of raw texts."""
    from paths import SF001
    from specsheet.operators.clean import clean_dataset
    from specsheet.sources.fixture import raw_specs

    raw_specs(spark, SF001).write.parquet(str(tmp_path / "raw"))
    sizes = method_sizes(spark, lambda: clean_dataset(spark.read.parquet(str(tmp_path / "raw"))))
    assert sizes and max(sizes) < 8000


def test_not_finite_empty_and_one_row(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, nan, 1.0), (3.0, 1.0, None), (4.0, 5.0, 2.0)], "a double, b double, c double")
    got = {(r["row"], r["col"]): r["corr"] for r in correlation_matrix(df, decimals=3).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and got["a", "a"] == 1.0
    assert got["a", "c"] == got["c", "a"] == round(np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1], 3)
    none = df.where(F.lit(False))
    assert {r["corr"] for r in correlation_matrix(none).collect()} == {None}
    assert {r["corr"] for r in correlation_matrix(df.limit(1)).collect()} == {None}

"""A report reads its rows once: it is computed from the written confusion matrix."""

import pytest

from specsheet.operators.metrics import classification_metrics, classification_report


def test_report_reads_rows_once(spark, tmp_path):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("a", None)]
    spark.createDataFrame(rows, "y string, p string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    rep = classification_report(df, "y", "p")
    assert "FileScan" not in rep._jdf.queryExecution().executedPlan().toString()
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in rep.collect()}
    assert got["a"] == (0.5, 0.5, 2) and got["b"] == (pytest.approx(2 / 3), 1.0, 2) and got["c"] == (0.0, 0.0, 1)
    assert classification_metrics(df, "y", "p").first()["accuracy"] == pytest.approx(3 / 5)

"""CSV source (SRC-1/2), chart sink (SNK-3) and the batch pipeline (PIP-2)."""

import pytest
from pyspark.sql import functions as F

from paths import SF001
from specsheet.sources.csv import REQUIRED_COLUMNS, check_required, load_specs_csv

ROW = ["Ferrari", "SF90", "V8", "3,990 cc", "963 hp", "340 km/h", "2.5 sec", "$1,100,000", "Hybrid", "2", "800 Nm"]


def _write(path, text, encoding):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_csv_reads_all_strings_with_row_ids(spark, tmp_path):
    p = tmp_path / "cars.csv"
    header = ",".join(f'"{h}"' for h in REQUIRED_COLUMNS)
    _write(p, header + "\n" + ",".join(f'"{v}"' for v in ROW) + "\n", "utf-8")
    df = load_specs_csv(spark, str(p))
    assert "row_id" in df.columns and all(t == "string" for c, t in df.dtypes if c != "row_id")
    assert df.first()["horsepower"] == "963 hp"


def test_csv_latin1_fallback(spark, tmp_path):
    p = tmp_path / "latin.csv"
    header = ",".join(f'"{h}"' for h in REQUIRED_COLUMNS)
    row = list(ROW)
    row[0] = "Citroën"
    _write(p, header + "\n" + ",".join(f'"{v}"' for v in row) + "\n", "latin-1")
    assert load_specs_csv(spark, str(p)).first()["company_names"] == "Citroën"


def test_csv_missing_file_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_specs_csv(spark, str(tmp_path / "nope.csv"))
    p = tmp_path / "short.csv"
    _write(p, '"Company Names","Cars Names"\n"A","B"\n', "utf-8")
    with pytest.raises(ValueError, match="no such columns"):
        load_specs_csv(spark, str(p))
    with pytest.raises(ValueError):
        check_required(spark.createDataFrame([(1,)], "x int"))


def test_pipeline_run_writes_charts_and_models(spark, tmp_path):
    from specsheet.plans.pipeline import run
    from specsheet.sources.fixture import raw_specs

    out = run(raw_specs(spark, SF001), str(tmp_path / "out"), fast=True).first()
    assert out["valid_rows"] <= out["rows"] and out["charts_written"] >= 8
    assert out["best_regressor"] in {"random_forest", "gradient_boosting", "ridge"}
    assert 0 <= out["coverage"] <= 1
    hist = spark.read.parquet(str(tmp_path / "out/charts/price_histogram"))
    assert hist.count() == 50
    from specsheet.operators.models import PricePredictor
    loaded = PricePredictor.load_model(str(tmp_path / "out/models/price_predictor"))
    assert loaded.is_fitted

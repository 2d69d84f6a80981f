"""Parquet tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


ROWS_A_TASK = 1 << 14  # parsing, fitting and attributing cost far more a row than reading it


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as their number asks for. A scan has a task per row group at most, and a
    table of few bytes a row may be a single one. Rows are counted first (for a plain scan, from the file
    footers); up to ``ROWS_A_TASK`` of them stay as they are."""
    tasks = -(-df.count() // ROWS_A_TASK)
    return df.repartition(tasks) if tasks > 1 else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

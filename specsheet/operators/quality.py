"""Data-quality queries: validation counts, issue list, duplicates, column summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_SHARE_LIMIT = 0.1


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else list(df.columns)


def validate_counts(df: DataFrame, company_col: str = "company_names", fuel_col: str = "fuel_types") -> DataFrame:
    """One row: total_rows, total_columns, unique_companies, unique_fuel_types (nulls not
    counted), duplicates."""
    base = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(company_col).alias("unique_companies"),
        F.count_distinct(fuel_col).alias("unique_fuel_types"),
    ).withColumn("total_columns", F.lit(len(df.columns)))
    return base.crossJoin(F.broadcast(duplicate_rows(df)))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long ``(column, dtype, missing, total_rows)``; one aggregate over all columns."""
    cols = _columns(df, columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                 F.col(f"__m{i}").alias("missing"), F.col("__n").alias("total_rows"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")


def _pct_text(missing, rows) -> F.Column:
    """``missing / rows * 100`` to one decimal, computed exactly on integers; an exact tie goes
    to the even digit, as Python's ``format(x, '.1f')`` does."""
    num = (missing * 1000).cast("bigint")
    fl = F.floor(num / rows).cast("bigint")
    twice_rem = (num - fl * rows) * 2
    tenths = (fl + F.when(twice_rem > rows, 1).when((twice_rem == rows) & (fl % 2 == 1), 1).otherwise(0)).cast("bigint")
    return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def validate_issues(df: DataFrame, columns: Sequence[str] | None = None, limit: float = MISSING_SHARE_LIMIT) -> DataFrame:
    """Columns with more than ``limit`` of their values missing (strict), with a message; then, if
    there are any, the duplicate rows (``column`` null, ``missing`` 0)."""
    mv = missing_values(df, columns).where(F.col("missing") > F.col("total_rows") * limit)
    repeats = duplicate_rows(df, columns).where("duplicates > 0").select(
        F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("missing"),
        F.concat(F.lit("Found "), F.col("duplicates").cast("string"), F.lit(" duplicate rows")).alias("issue"))
    return mv.select(
        "column", "missing",
        F.concat(F.lit("Column '"), F.col("column"), F.lit("' has "), F.col("missing").cast("string"),
                 F.lit(" missing values ("), _pct_text(F.col("missing"), F.col("total_rows")), F.lit("%)"))
        .alias("issue")).unionByName(repeats)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``duplicates``: rows beyond the first of each identical group (nulls equal).

    Digests first: rows are counted by a 128-bit digest of their values and null places, with map-side combine,
    so 16 bytes a row are shuffled however wide it is. Only rows whose digest is repeated are then grouped
    by their values, so the count is exact whatever the digests do.
    """
    cols = [f"`{c}`" for c in _columns(df, columns)]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])  # a hash passes over nulls
    digest = {"__one": F.xxhash64(nulls, *cols), "__two": F.xxhash64(F.lit(1), nulls, *cols)}
    rows = df.select(*cols).withColumns(digest)
    repeated = rows.groupBy("__one", "__two").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").drop("__c")
    groups = rows.join(repeated, ["__one", "__two"], "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def column_summary(df: DataFrame, columns: Sequence[str] | None = None, order_col: str = "row_id") -> DataFrame:
    """Per column: dtype, non_null_count, null_count, null_percentage (2 dp), unique_values
    (nulls excluded), sample_value (text of the first row by ``order_col``).

    Values are counted by column and text first, in aggregates of numbers that hash and spill; no task holds a column."""
    cols = _columns(df, columns)
    types = dict(df.dtypes)
    order = F.col(order_col) if order_col in df.columns else F.monotonically_increasing_id()
    texts = df.select(order.alias("__o"), F.array(*[F.col(f"`{c}`").cast("string") for c in cols]).alias("__v"))
    first = texts.agg(F.min_by("__v", "__o").alias("__first"))  # one row
    long = texts.select(F.posexplode("__v").alias("__p", "value"))
    counts = long.groupBy("__p", "value").agg(F.count(F.lit(1)).alias("__c"))
    known = F.col("value").isNotNull()
    agg = counts.groupBy("__p").agg(
        F.coalesce(F.sum(F.when(known, F.col("__c"))), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(~known, F.col("__c"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_values"),
    ).withColumn("column", F.get(F.array(*[F.lit(c) for c in cols]), F.col("__p"))).crossJoin(F.broadcast(first))
    dtype = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    total = F.col("non_null_count") + F.col("null_count")
    return agg.select(
        "column", dtype[F.col("column")].alias("dtype"), "non_null_count", "null_count",
        F.round(F.col("null_count") / total * 100, 2).alias("null_percentage"), "unique_values",
        F.get("__first", F.col("__p")).alias("sample_value"))

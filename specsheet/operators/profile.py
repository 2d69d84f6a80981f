"""Profiling and grouped aggregation (describe, value counts, moments, correlation, outliers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.moments import pair_correlations
from ..functions.stats import attach, quantiles, sample_kurtosis, sample_skewness
from ..session import materialize
from .clean import ACCEL, FUEL, HP, MAKER, PRICE
from .features import performance_category_expr

ID_COLUMNS = ("row_id",)


def _round(c: Column, decimals: int | None) -> Column:
    return c if decimals is None else F.round(c, decimals)


def _nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric, non-boolean columns other than the row key."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in ID_COLUMNS]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def to_long(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    """Unpivot ``columns`` into ``(column, value)`` rows (one pass, no shuffle)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns
    ])).alias("kv")).select("kv.column", "kv.value")


def basic_statistics(df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = None,
                     exact: bool = True) -> DataFrame:
    """One row per numeric column: count, mean, std (sample), min, q25, q50, q75, max,
    missing, missing_pct (of all rows, 2 dp)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    long = to_long(df, cols)
    out = quantiles(long, "value", [0.25, 0.5, 0.75], by="column", exact=exact, few_groups=True, aggs=[
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("__rows"),
    ]).drop("n")
    return out.select(
        "column", "count",
        *[_round(F.col(c), decimals).alias(c) for c in ("mean", "std", "min")],
        _round(F.col("q0"), decimals).alias("q25"), _round(F.col("q1"), decimals).alias("q50"),
        _round(F.col("q2"), decimals).alias("q75"), _round(F.col("max"), decimals).alias("max"),
        "missing", F.round(F.col("missing") / F.col("__rows") * 100, 2).alias("missing_pct"),
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: value -> count and % of non-null rows (2 dp). Long format
    ``(column, value, count, percentage)``; totals come from a grouped aggregate (no
    window over a high-cardinality column)."""
    cols = list(columns) if columns is not None else string_columns(df)
    long = to_long(df, cols, cast="string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = long.groupBy("column").agg(F.count(F.lit(1)).alias("__total"))
    return counts.join(totals, "column").select(
        "column", "value", "count", F.round(F.col("count") / F.col("__total") * 100, 2).alias("percentage"))


def price_distribution(df: DataFrame, price_col: str = PRICE, decimals: int | None = None,
                       exact: bool = True) -> DataFrame:
    """One row: mean, median, std, min, max, q25, q75, iqr, skewness, kurtosis (bias-corrected),
    count."""
    x = F.col(price_col).cast("double")
    moments = df.where(x.isNotNull()).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"), F.count(x).alias("count"))
    qs = quantiles(df, price_col, [0.25, 0.5, 0.75], exact=exact)
    # An empty input has no quantile row; keep the one moments row anyway.
    out = moments.join(F.broadcast(qs), how="left")
    r = lambda c: _round(c, decimals)
    return out.select(
        r(F.col("mean")).alias("mean"), r(F.col("q1")).alias("median"), r(F.col("std")).alias("std"),
        r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), r(F.col("q0")).alias("q25"),
        r(F.col("q2")).alias("q75"), r(F.col("q2") - F.col("q0")).alias("iqr"),
        r(F.col("skewness")).alias("skewness"), r(F.col("kurtosis")).alias("kurtosis"), "count")


# Price band edges (USD) and names.
PRICE_BANDS = [30000, 100000, 500000]
PRICE_BAND_NAMES = ["budget", "mid_range", "premium", "luxury"]


def price_segments(df: DataFrame, price_col: str = PRICE, edges: Sequence[float] = PRICE_BANDS, extra: Sequence[Column] = ()) -> DataFrame:
    """One row of counts per band: [-inf,e0), [e0,e1), [e1,e2), [e2,inf). ``extra``: further aggregates of the
    same scan."""
    x = F.col(price_col)
    a, b, c = edges
    return df.agg(
        F.count_if(x < a).alias(PRICE_BAND_NAMES[0]),
        F.count_if((x >= a) & (x < b)).alias(PRICE_BAND_NAMES[1]),
        F.count_if((x >= b) & (x < c)).alias(PRICE_BAND_NAMES[2]),
        F.count_if(x >= c).alias(PRICE_BAND_NAMES[3]),
        *extra,
    )


def by_brand(df: DataFrame, company_col: str = MAKER, price_col: str = PRICE, hp_col: str = HP,
             decimals: int | None = 2, exact: bool = True) -> DataFrame:
    """Per maker: priced-row count, mean/median/min/max price, mean/max power; ordered by count
    desc then maker. Null makers are dropped (as a pandas group-by does)."""
    # One grouped pass computes the plain aggregates together with the median's sketch.
    aggs = [F.count(price_col).alias("car_count"), F.avg(price_col).alias("avg_price"),
            F.min(price_col).alias("min_price"), F.max(price_col).alias("max_price"),
            F.avg(hp_col).alias("avg_hp"), F.max(hp_col).alias("max_hp")]
    med = quantiles(df, price_col, [0.5], by=company_col, exact=exact, aggs=aggs).withColumnRenamed(
        "q0", "median_price")
    r = lambda c: _round(F.col(c).cast("double"), decimals).alias(c)
    return med.select(
        company_col, "car_count", r("avg_price"), r("median_price"), r("min_price"), r("max_price"),
        r("avg_hp"), r("max_hp"),
    ).orderBy(F.desc("car_count"), company_col)


def by_fuel_type(df: DataFrame, fuel_col: str = FUEL, price_col: str = PRICE, hp_col: str = HP,
                 acc_col: str = ACCEL, decimals: int | None = 2) -> DataFrame:
    """Per fuel class: ``<col>_count`` and ``<col>_mean`` of each measure present in ``df``."""
    present = [c for c in (price_col, hp_col, acc_col) if c in df.columns]
    aggs = []
    for c in present:
        aggs += [F.count(c).alias(f"{c}_count"), _round(F.avg(c), decimals).alias(f"{c}_mean")]
    return df.where(F.col(fuel_col).isNotNull()).groupBy(fuel_col).agg(*aggs)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = 3) -> DataFrame:
    """Pearson correlation on pairwise-complete rows, long format ``(row, col, corr)``.

    All unordered pairs come from one pass of matrix products (``functions/moments``); the result is
    mirrored. A constant column gives null.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = pair_correlations(df, cols)
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    rows = pairs.select("i", "j", "corr", F.inline(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)))
    return rows.select(F.get(names, F.col("a")).alias("row"), F.get(names, F.col("b")).alias("col"), _round(F.col("corr"), decimals).alias("corr"))


def _iqr_bounds(df: DataFrame, column: str, threshold: float, exact: bool) -> DataFrame:
    q = quantiles(df, column, [0.25, 0.75], exact=exact)
    iqr = F.col("q1") - F.col("q0")
    return q.select((F.col("q0") - threshold * iqr).alias("lower_bound"),
                    (F.col("q1") + threshold * iqr).alias("upper_bound"))


def _z_bounds(df: DataFrame, column: str, threshold: float) -> DataFrame:
    x = F.col(column).cast("double")
    s = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return s.select((F.col("m") - threshold * F.col("s")).alias("lower_bound"),
                    (F.col("m") + threshold * F.col("s")).alias("upper_bound"),
                    F.col("m").alias("__mean"), F.col("s").alias("__std"))


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5,
                   exact: bool = True) -> DataFrame:
    return _iqr_bounds(df, column, threshold, exact) if method == "iqr" else _z_bounds(df, column, threshold)


def identify_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5,
                      exact: bool = True) -> DataFrame:
    """Rows outside ``q1 - t*IQR .. q3 + t*IQR`` (iqr) or with ``|x - mean| / std > t`` (zscore)."""
    b = outlier_bounds(df, column, method, threshold, exact)
    j = attach(df, b, [])
    x = F.col(column)
    if method == "iqr":
        cond = (x < F.col("lower_bound")) | (x > F.col("upper_bound"))
    else:
        cond = F.abs((x - F.col("__mean")) / F.nullif(F.col("__std"), F.lit(0.0))) > threshold
    return j.where(cond).select(*df.columns)


def outlier_stats(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5,
                  exact: bool = True) -> DataFrame:
    """One row: total_outliers, outlier_percentage (of all rows), lower_bound, upper_bound."""
    b = outlier_bounds(df, column, method, threshold, exact)
    j = attach(df, b, [])
    x = F.col(column)
    if method == "iqr":
        cond = (x < F.col("lower_bound")) | (x > F.col("upper_bound"))
    else:
        cond = F.abs((x - F.col("__mean")) / F.nullif(F.col("__std"), F.lit(0.0))) > threshold
    return j.groupBy("lower_bound", "upper_bound").agg(
        F.count_if(cond).alias("total_outliers"), F.count(F.lit(1)).alias("__n")
    ).select("total_outliers", (F.col("total_outliers") / F.col("__n") * 100).alias("outlier_percentage"),
             "lower_bound", "upper_bound")


def performance_vs_price(df: DataFrame, acc_col: str = ACCEL, price_col: str = PRICE,
                         decimals: int | None = None, exact: bool = True) -> DataFrame:
    """Correlation of time vs price on complete pairs, and per category mean/median/count of
    price. One row per category, the correlation repeated on each."""
    valid = df.where(F.col(acc_col).isNotNull() & F.col(price_col).isNotNull()) \
        .withColumn("category", performance_category_expr(acc_col))
    corr = valid.agg(_nan_to_null(F.corr(F.col(acc_col).cast("double"), F.col(price_col).cast("double")))
                     .alias("correlation"))
    cat = valid.groupBy("category").agg(F.avg(price_col).alias("mean"), F.count(price_col).alias("count"))
    med = quantiles(valid, price_col, [0.5], by="category", exact=exact).select(
        "category", F.col("q0").alias("median"))
    out = attach(cat.join(med, "category", "left"), corr, [])
    return out.select("category", _round(F.col("mean"), decimals).alias("mean"),
                      _round(F.col("median"), decimals).alias("median"), "count",
                      _round(F.col("correlation"), decimals).alias("correlation"))


def _report_statistics(df: DataFrame, numeric: Sequence[str], measures: Sequence[str], exact: bool) -> DataFrame:
    """One row per ``(section, item)`` with count, moments, extremes and quartiles: numeric columns, and price,
    power and measures per maker, fuel and performance category. All sections share one exploded scan
    (and the passes of one quantile select); the result is small and written once."""
    number = lambda c: F.col(c).cast("double")
    parts = [("column", F.lit(c), number(c)) for c in numeric]
    if MAKER in df.columns:
        parts += [("maker price", F.col(MAKER), number(PRICE)), ("maker power", F.col(MAKER), number(HP))]
    if FUEL in df.columns:
        parts += [(f"fuel {c}", F.col(FUEL), number(c)) for c in measures]
    if ACCEL in df.columns:
        both = F.col(ACCEL).isNotNull() & F.col(PRICE).isNotNull()
        parts.append(("category", F.when(both, performance_category_expr(ACCEL)), number(PRICE)))
    long = df.select(F.inline(F.array(*[F.struct(
        F.lit(section).alias("section"), item.cast("string").alias("item"), value.alias("value")) for section, item, value in parts])))
    v = F.col("value")
    stats = quantiles(long, "value", [0.25, 0.5, 0.75], by=["section", "item"], exact=exact, aggs=[
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"), F.count(F.lit(1)).alias("rows")])
    names = {"q0": "q25", "q1": "q50", "q2": "q75"}
    return materialize(stats.drop("n").withColumnsRenamed(names))


def eda_report(df: DataFrame, exact: bool = True, rounded: bool = True) -> dict[str, DataFrame]:
    """Bundle of profiles; optional parts depend on which columns exist. ``rounded=False`` keeps
    full precision (the reference rounds brand/fuel figures to 2 dp and correlations to 3).

    Eager: six scans of ``df`` write three small tables (statistics per group, correlations, band counts) and
    every section reads those.
    """
    two, three = (2, 3) if rounded else (None, None)
    numeric = numeric_columns(df)
    measures = [c for c in (PRICE, HP, ACCEL) if c in df.columns]
    stats = _report_statistics(df, numeric, measures, exact)
    correlations = materialize(correlation_matrix(df, numeric, decimals=None))
    bands = materialize(price_segments(df, extra=[F.count(F.lit(1)).alias("rows")]))

    def section(name: str, *columns: Column, key: str = "item") -> DataFrame:
        return stats.where(F.col("section") == name).select(F.col("item").alias(key), *columns)

    price = stats.where((F.col("section") == "column") & (F.col("item") == PRICE))
    report = {
        "dataset_shape": bands.select("rows", F.lit(len(df.columns)).alias("columns")),
        "basic_statistics": section("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", (F.col("rows") - F.col("count")).alias("missing"),
                                    F.round((F.col("rows") - F.col("count")) / F.col("rows") * 100, 2).alias("missing_pct"), key="column"),
        "price_analysis": price.select("mean", F.col("q50").alias("median"), "std", "min", "max", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"),
                                       "skewness", "kurtosis", "count"),
        "price_segments": bands.drop("rows"),
        "correlation_matrix": correlations.select("row", "col", _round(F.col("corr"), three).alias("corr")),
    }
    if MAKER in df.columns:
        r = lambda c, name: _round(F.col(c), two).alias(name)
        power = section("maker power", r("mean", "avg_hp"), r("max", "max_hp"), key=MAKER)
        report["brand_analysis"] = section(
            "maker price", F.col("count").alias("car_count"), r("mean", "avg_price"), r("q50", "median_price"), r("min", "min_price"),
            r("max", "max_price"), key=MAKER).join(power, MAKER).orderBy(F.desc("car_count"), MAKER)
    if FUEL in df.columns:
        fuel = None
        for c in measures:
            part = section(f"fuel {c}", F.col("count").alias(f"{c}_count"), _round(F.col("mean"), two).alias(f"{c}_mean"), key=FUEL)
            fuel = part if fuel is None else fuel.join(part, FUEL)
        report["fuel_type_analysis"] = fuel
    if ACCEL in df.columns and PRICE in df.columns:
        both = correlations.where((F.col("row") == ACCEL) & (F.col("col") == PRICE)).select(F.col("corr").alias("correlation"))
        report["performance_price"] = attach(section("category", "mean", F.col("q50").alias("median"), "count", key="category"), both, [])
    return report


def eda_report_long(df: DataFrame, decimals: int | None = 6, exact: bool = True) -> DataFrame:
    """The report flattened to ``(section, item, metric, value)`` rows (numeric values only)."""
    rep = eda_report(df, exact=exact, rounded=False)
    parts = []
    keys = {"basic_statistics": "column", "correlation_matrix": None, "brand_analysis": MAKER,
            "fuel_type_analysis": FUEL, "performance_price": "category"}
    for section, frame in rep.items():
        if section == "correlation_matrix":
            item = F.concat_ws("|", "row", "col")
            metrics = ["corr"]
        else:
            key = keys.get(section)
            item = F.col(key).cast("string") if key else F.lit("")
            metrics = [c for c in frame.columns if c != key]
        parts.append(frame.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), _round(F.col(m).cast("double"), decimals).alias("value"))
            for m in metrics])).alias("kv")).select("section", "item", "kv.metric", "kv.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

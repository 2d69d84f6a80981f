"""Chart data: the aggregates behind every plot, as DataFrames (drawing is left to the caller).

Each function returns the numbers a chart shows, computed where the data lives; only the
small result ever needs to leave the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import attach, quantiles
from .clean import ACCEL, FUEL, HP, MAKER, PRICE, SPEED
from .features import CATEGORIES, PERF_CATEGORY
from .profile import correlation_matrix


def _trimmed(df: DataFrame, col: str, trim_q: float | None, exact: bool) -> DataFrame:
    rows = df.where(F.col(col).isNotNull())
    if trim_q is None:
        return rows
    bound = quantiles(rows, col, [trim_q], exact=exact, prefix="__t").select("__t0")
    return attach(rows, bound, []).where(F.col(col) <= F.col("__t0")).drop("__t0")


def histogram(df: DataFrame, col: str = PRICE, bins: int = 50, trim_q: float | None = 0.99,
              exact: bool = True) -> DataFrame:
    """Equal-width bins over ``[min, max]`` of the (trimmed) values; the last bin is closed.

    Returns every bin ``(bin, lower, upper, count)`` including empty ones. A constant column
    falls in the middle bin of the range ``[v - 0.5, v + 0.5]`` (NumPy's rule).

    Three passes over the rows when trimming (two for the exact quantile, which also yields the
    trimmed range; one for the counts), one fewer without. The range rides along as a grouping
    key, and the empty bins are filled from the at most ``bins`` counted rows, so no statistic is
    computed twice.
    """
    x = F.col(col).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    if trim_q is None:
        rng = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.lit(None).cast("double").alias("cap"))
    else:
        q = quantiles(rows, "x", [trim_q], exact=exact, prefix="__t", bounds=True)
        rng = q.select(F.col("min").alias("lo"), F.col("__tle0").alias("hi"), F.col("__t0").alias("cap"))
    rng = rng.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "cap")
    kept = attach(rows, rng, []).where(F.col("cap").isNull() | (F.col("x") <= F.col("cap")))
    idx = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = kept.groupBy(idx.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    packed = counts.groupBy("lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    b = F.col("bin")
    return packed.select("lo", "hi", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        b.alias("bin"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * b / bins).alias("lower"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (b + 1) / bins).alias("upper"),
        F.coalesce(F.col("m")[b], F.lit(0)).cast("bigint").alias("count"))


def box_summary(df: DataFrame, col: str = PRICE, by: str | Sequence[str] | None = None,
                trim_q: float | None = None, whisker: float = 1.5, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside ``whisker * IQR``) and outlier count,
    overall or per group."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    rows = _trimmed(df, col, trim_q, exact)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    q = quantiles(rows, col, [0.25, 0.5, 0.75], by=keys or None, exact=exact)
    iqr = F.col("q2") - F.col("q0")
    q = q.select(*keys, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
                 (F.col("q0") - whisker * iqr).alias("__lf"), (F.col("q2") + whisker * iqr).alias("__uf"))
    x = F.col(col).cast("double")
    inside = (x >= F.col("__lf")) & (x <= F.col("__uf"))
    j = attach(rows.select(*keys, col), q, keys)
    return j.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def corr_lower(df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = 3) -> DataFrame:
    """Lower triangle of the correlation matrix, diagonal excluded (``row`` after ``col``)."""
    m = correlation_matrix(df, columns, decimals)
    cols = list(columns) if columns is not None else None
    if cols is None:
        from .profile import numeric_columns
        cols = numeric_columns(df)
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return m.where(pos[F.col("row")] > pos[F.col("col")])


def top_groups(df: DataFrame, key: str = MAKER, top_n: int = 15) -> DataFrame:
    """The ``top_n`` most frequent non-null keys (ties by key)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__cnt"))
            .orderBy(F.desc("__cnt"), key).limit(top_n).select(key))


def top_group_box(df: DataFrame, key: str = MAKER, col: str = PRICE, top_n: int = 15,
                  exact: bool = True) -> DataFrame:
    """Box summary per key for the ``top_n`` most frequent keys, ordered by median desc.

    The key list has at most ``top_n`` entries (a proven bound): it is resolved once and applied
    as an ``isin`` of literals, which reaches the parquet scan and is not recomputed by each of
    the box summary's passes.
    """
    keys = [r[0] for r in top_groups(df, key, top_n).collect()]
    keep = df.where(F.col(key).isin(*keys))
    return box_summary(keep, col, by=key, exact=exact).orderBy(F.desc("median"), key)


def value_share(df: DataFrame, key: str = FUEL, decimals: int | None = 1) -> DataFrame:
    """Count per non-null key and share of the non-null rows in percent."""
    rows = df.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    pct = F.col("count") / F.col("__n") * 100
    return attach(counts, total, []).select(
        key, "count", (pct if decimals is None else F.round(pct, decimals)).alias("percentage"))


def scatter_set(df: DataFrame, x: str = ACCEL, y: str = SPEED, color: str = PRICE, trim_q: float = 0.95,
                keep: Sequence[str] = ("row_id",), exact: bool = True) -> DataFrame:
    """Complete ``(x, y, color)`` rows whose colour value is at most its ``trim_q`` quantile."""
    cols = [c for c in dict.fromkeys([*keep, x, y, color]) if c in df.columns]
    rows = df.select(*cols).dropna(subset=[x, y, color])
    return _trimmed(rows, color, trim_q, exact)


def trend_line(df: DataFrame, x: str = HP, y: str = PRICE, trim_q: float = 0.95, exact: bool = True) -> DataFrame:
    """OLS line and Pearson correlation of ``y`` on ``x`` over complete rows with ``y`` at most
    its ``trim_q`` quantile."""
    rows = _trimmed(df.select(x, y).dropna(), y, trim_q, exact)
    return rows.agg(F.count(F.lit(1)).alias("n"),
                    F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                    F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                    F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("correlation"))


def ordered_counts(df: DataFrame, key: str = PERF_CATEGORY, order: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """Counts of ``key`` in a fixed category order; absent categories give 0."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(order)], f"position int, {key} string")
    counts = df.where(F.col(key).isin(*order)).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return F.broadcast(dim).join(counts, key, "left").select(
        "position", key, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def scatter_by_category(df: DataFrame, x: str = HP, y: str = PRICE, key: str = PERF_CATEGORY,
                        keep: Sequence[str] = tuple(CATEGORIES), trim_q: float = 0.95,
                        id_cols: Sequence[str] = ("row_id",), exact: bool = True) -> DataFrame:
    """Rows of the known categories with ``y`` at most its ``trim_q`` quantile (over all rows)."""
    rows = _trimmed(df, y, trim_q, exact).where(F.col(key).isin(*keep))
    cols = [c for c in dict.fromkeys([*id_cols, x, y, key]) if c in df.columns]
    return rows.select(*cols)


def top_importance(importance: DataFrame, top_n: int = 10, value_col: str = "importance") -> DataFrame:
    """The ``top_n`` largest importances (ties by feature name)."""
    return importance.orderBy(F.desc(value_col), "feature").limit(top_n)

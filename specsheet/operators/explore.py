"""Dashboard queries: overview tiles, shares, top groups, per-group top-k, browse, lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import ACCEL, HP, MAKER, NAME, PRICE, SPEED, FUEL
from .features import CATEGORIES, PERF_CATEGORY

# Columns shown by the browse table and the per-category leader table.
BROWSE_COLUMNS = [MAKER, NAME, PRICE, HP, SPEED, ACCEL, FUEL, PERF_CATEGORY]
LEADER_COLUMNS = [MAKER, NAME, ACCEL, HP, PRICE]


def overview(df: DataFrame, company_col: str = MAKER, price_col: str = PRICE, hp_col: str = HP) -> DataFrame:
    """One row: total rows, distinct makers, mean price, mean power."""
    return df.agg(F.count(F.lit(1)).alias("total_cars"), F.count_distinct(company_col).alias("manufacturers"),
                  F.avg(price_col).alias("average_price"), F.avg(hp_col).alias("average_hp"))


def category_share(df: DataFrame, key: str = PERF_CATEGORY, decimals: int | None = None) -> DataFrame:
    """Count per non-null key and its share of *all* rows, in percent."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    pct = F.col("count") / F.col("__n") * 100
    return counts.crossJoin(F.broadcast(total)).select(
        key, "count", (pct if decimals is None else F.round(pct, decimals)).alias("percentage"))


def top_groups_by_mean(df: DataFrame, key: str = MAKER, col: str = PRICE, min_n: int = 10, k: int = 10) -> DataFrame:
    """Groups with at least ``min_n`` non-null values, the ``k`` highest means (ties by key)."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(col).alias("mean"), F.count(col).alias("count"))
    return g.where(F.col("count") >= min_n).orderBy(F.desc("mean"), key).limit(k)


def group_means(df: DataFrame, key: str = PERF_CATEGORY, cols: Sequence[str] = (PRICE, HP, SPEED, ACCEL),
                decimals: int | None = 0) -> DataFrame:
    aggs = [F.avg(c) for c in cols]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        (a if decimals is None else F.round(a, decimals)).alias(f"avg_{c}") for a, c in zip(aggs, cols)])


def smallest_per_group(df: DataFrame, key: str = PERF_CATEGORY, col: str = ACCEL, k: int = 5,
                       groups: Sequence[str] | None = tuple(CATEGORIES), columns: Sequence[str] = LEADER_COLUMNS,
                       order_col: str = "row_id") -> DataFrame:
    """The ``k`` smallest non-null ``col`` per group, ties by ``order_col``.

    ``row_number() <= k`` lets Spark insert a per-partition group limit before the shuffle,
    so a hot group sends at most ``k`` rows per map task.
    """
    rows = df.where(F.col(col).isNotNull())
    if groups is not None:
        rows = rows.where(F.col(key).isin(*groups))
    w = Window.partitionBy(key).orderBy(F.col(col), F.col(order_col))
    cols = [c for c in dict.fromkeys([key, *columns, order_col])]
    return rows.select(*cols, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def filter_choices(df: DataFrame, company_col: str = MAKER, category_col: str = PERF_CATEGORY,
                   price_col: str = PRICE) -> DataFrame:
    """Long ``(choice, value)``: every distinct maker, every distinct category, and the
    whole-number maximum price."""
    makers = df.where(F.col(company_col).isNotNull()).select(F.lit("maker").alias("choice"),
                                                             F.col(company_col).alias("value")).distinct()
    cats = df.where(F.col(category_col).isNotNull()).select(F.lit("category").alias("choice"),
                                                            F.col(category_col).alias("value")).distinct()
    top = df.agg(F.max(price_col).alias("m")).select(
        F.lit("max_price").alias("choice"), F.floor("m").cast("bigint").cast("string").alias("value"))
    return makers.unionByName(cats).unionByName(top)


def item_label(company_col: str = MAKER, name_col: str = NAME) -> F.Column:
    """``maker + ' ' + name``; null when either part is null."""
    return F.concat(F.col(company_col), F.lit(" "), F.col(name_col))


def lookup_labels(df: DataFrame, company_col: str = MAKER, name_col: str = NAME, order_col: str = "row_id") -> DataFrame:
    """Every label resolved to its first row (``label``, ``row_id``, ``matches``)."""
    return df.select(item_label(company_col, name_col).alias("label"), F.col(order_col)).where(
        F.col("label").isNotNull()).groupBy("label").agg(
        F.min(order_col).alias(order_col), F.count(F.lit(1)).alias("matches"))


def lookup_label(df: DataFrame, label: str, company_col: str = MAKER, name_col: str = NAME,
                 order_col: str = "row_id") -> DataFrame:
    """The first row whose label equals ``label`` (empty when none)."""
    hits = df.where(item_label(company_col, name_col) == F.lit(label))
    first = hits.agg(F.min(order_col).alias(order_col))
    return hits.join(F.broadcast(first), order_col, "left_semi")


def browse(df: DataFrame, maker: str | None = None, category: str | None = None, price_min: float = 0,
           price_max: float = 500000, n: int = 50, columns: Sequence[str] = BROWSE_COLUMNS,
           order_col: str = "row_id") -> DataFrame:
    """Optional maker / category equality, inclusive price range, first ``n`` rows in order."""
    rows = df
    if maker is not None:
        rows = rows.where(F.col(MAKER) == maker)
    if category is not None:
        rows = rows.where(F.col(PERF_CATEGORY) == category)
    rows = rows.where(F.col(PRICE).between(price_min, price_max))
    return rows.select(order_col, *columns).orderBy(order_col).limit(n)


def what_if(regressor, classifier, specs: DataFrame) -> DataFrame:
    """Score spec rows (any number) with a fitted price model and category model."""
    priced = regressor.predict(specs, out="predicted_price")
    return classifier.predict(priced, out="predicted_category")

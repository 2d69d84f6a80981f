"""Derived features, encoders and scalers (sklearn edge rules, Spark plans)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import attach, quantiles, with_dense_index
from .clean import ACCEL, CC, FUEL, HP, MAKER, PRICE, SEATS, SPEED, TORQUE
from ..functions.text import strip

# Performance thresholds (seconds, 0-100 km/h) and category names.
HIGH_PERF_BELOW = 4.5
MID_RANGE_UP_TO = 8.0
CATEGORIES = ["High-Performance", "Mid-Range", "Economy"]
UNKNOWN = "Unknown"

# Makers counted as luxury (matched after lower-casing and stripping).
LUXURY_BRANDS = [
    "ferrari", "rolls royce", "rolls-royce", "lamborghini", "bentley",
    "aston martin", "maserati", "bugatti", "mclaren", "porsche",
    "mercedes", "mercedes-benz", "bmw", "audi", "lexus", "jaguar",
    "land rover", "range rover", "cadillac", "lincoln", "genesis",
    "infinity", "infiniti", "acura", "alfa romeo", "maybach", "pagani",
    "koenigsegg", "rimac", "lotus",
]

# Fuel classes counted as electrified.
ELECTRIFIED = ["Electric", "Hybrid", "Plug-in Hybrid"]

# Default feature lists.
RECOMMENDER_FEATURES = [HP, SPEED, ACCEL, TORQUE, CC, SEATS, PRICE]
MODEL_NUMERIC = [HP, SPEED, ACCEL, TORQUE, CC, SEATS]
MODEL_CATEGORICAL = [FUEL, MAKER]

PERF_CATEGORY = "Performance_Category"
IS_LUXURY = "Is_Luxury_Brand"
PRICE_PER_HP = "Price_Per_HP"
POWER_TO_SPEED = "Power_To_Speed_Ratio"
IS_ELECTRIC = "Is_Electric"


def performance_category_expr(c: str, high: float = HIGH_PERF_BELOW, mid: float = MID_RANGE_UP_TO):
    col = F.col(c)
    return (
        F.when(col.isNull(), UNKNOWN)
        .when(col < high, CATEGORIES[0])
        .when(col <= mid, CATEGORIES[1])
        .otherwise(CATEGORIES[2])
    )


def create_performance_category(
    df: DataFrame, acceleration_col: str = ACCEL, high: float = HIGH_PERF_BELOW,
    mid: float = MID_RANGE_UP_TO, out: str = PERF_CATEGORY,
) -> DataFrame:
    return df.withColumn(out, performance_category_expr(acceleration_col, high, mid))


def luxury_expr(c: str):
    return F.coalesce(F.lower(strip(c)).isin(*LUXURY_BRANDS), F.lit(False))


def create_luxury_brand_feature(df: DataFrame, company_col: str = MAKER, out: str = IS_LUXURY) -> DataFrame:
    return df.withColumn(out, luxury_expr(company_col))


def create_price_per_hp(df: DataFrame, price_col: str = PRICE, hp_col: str = HP, out: str = PRICE_PER_HP) -> DataFrame:
    return df.withColumn(out, F.col(price_col) / F.nullif(F.col(hp_col), F.lit(0)))


def create_power_to_speed_ratio(
    df: DataFrame, hp_col: str = HP, speed_col: str = SPEED, out: str = POWER_TO_SPEED
) -> DataFrame:
    return df.withColumn(out, F.col(hp_col) / F.nullif(F.col(speed_col), F.lit(0)))


def create_is_electric(df: DataFrame, fuel_col: str = FUEL, out: str = IS_ELECTRIC) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(fuel_col).isin(*ELECTRIFIED), F.lit(False)))


def create_all_features(df: DataFrame) -> DataFrame:
    """All five derived columns in one projection."""
    return df.withColumns({
        PERF_CATEGORY: performance_category_expr(ACCEL),
        IS_LUXURY: luxury_expr(MAKER),
        PRICE_PER_HP: F.col(PRICE) / F.nullif(F.col(HP), F.lit(0)),
        POWER_TO_SPEED: F.col(HP) / F.nullif(F.col(SPEED), F.lit(0)),
        IS_ELECTRIC: F.coalesce(F.col(FUEL).isin(*ELECTRIFIED), F.lit(False)),
    })


# ---------------------------------------------------------------- encoders


def label_mapping(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of ``column`` -> code 0..k-1 (``value``, ``code``).

    Fitting the encoder: the distinct values are range-sorted and densely numbered (no
    single-partition window, so a high-cardinality column is fine).
    """
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_dense_index(values, ["value"], "__pos").select("value", F.col("__pos").cast("double").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_Encoded") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Add ``<col>_Encoded`` (double, null for null) per column; returns the mappings too."""
    out = df
    mappings: dict[str, DataFrame] = {}
    for c in columns:
        m = label_mapping(df, c)
        mappings[c] = m
        enc = m.select(F.col("value").alias(f"__key_{c}"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(enc, out[c].cast("string") == enc[f"__key_{c}"], "left").drop(f"__key_{c}")
    return out, mappings


def one_hot(df: DataFrame, columns: Sequence[str], max_values: int | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """One boolean column ``<col>_<value>`` per distinct value, sorted; null -> all false.

    The value list becomes the output schema, so it is collected. ``max_values`` is an optional
    guard: a column with more distinct values raises.
    """
    out = df
    names: dict[str, list[str]] = {}
    for c in columns:
        vals = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct()
                .orderBy(1).collect()]
        if max_values is not None and len(vals) > max_values:
            raise ValueError(f"{c} has more than {max_values} distinct values")
        cols = {f"{c}_{v}": F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)) for v in vals}
        out = out.withColumns(cols)
        names[c] = list(cols)
    return out, names


def one_hot_vectors(df: DataFrame, columns: Sequence[str], suffix: str = "_Vector") -> tuple[DataFrame, dict[str, DataFrame]]:
    """One sparse 0/1 vector column ``<col>_Vector`` per column instead of a column per value, with the code table
    (``value``, ``code``) that names its places; null -> all zeros. Values are numbered as by
    ``label_encode`` and never collected, so their number is bounded by nothing but the vector's length."""
    out, mappings = label_encode(df, columns, "__Code")
    for c in columns:
        size = mappings[c].count()  # one number
        code = f"{c}__Code"
        out = out.withColumn(code, F.coalesce(F.col(code), F.lit(float(size))))  # null: the place that dropLast leaves out
        sizes = df.sparkSession.range(size, size + 1).select(F.col("id").cast("double").alias(code))  # the greatest code
        model = OneHotEncoder(inputCol=code, outputCol=f"{c}{suffix}", dropLast=True).fit(sizes)
        out = model.transform(out).drop(code)
    return out, mappings


# ---------------------------------------------------------------- scalers


def _complete(columns: Sequence[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def scaler_stats(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One-row fitted scaler: per column (center, scale) computed on complete rows."""
    rows = df.where(_complete(columns))
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"__c{i}"), F.stddev_pop(x).alias(f"__s{i}")]
        else:
            aggs += [F.min(x).alias(f"__c{i}"), (F.max(x) - F.min(x)).alias(f"__s{i}")]
    return rows.agg(*aggs)


def apply_scaler(df: DataFrame, columns: Sequence[str], stats: DataFrame, suffix: str = "_Scaled") -> DataFrame:
    """``(x - center) / scale`` on complete rows (scale 0 -> 1, as sklearn); others null."""
    joined = attach(df, stats, [])
    comp = _complete(columns)
    out = joined.withColumns({
        f"{c}{suffix}": F.when(
            comp,
            (F.col(c) - F.col(f"__c{i}")) / F.coalesce(F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(1.0)),
        )
        for i, c in enumerate(columns)
    })
    return out.drop(*[f"__c{i}" for i in range(len(columns))], *[f"__s{i}" for i in range(len(columns))])


def scale_numerical_features(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Standard (population sigma) or min-max scaling into ``<col>_Scaled``."""
    return apply_scaler(df, columns, scaler_stats(df, columns, method))


def prepare_features_for_modeling(
    df: DataFrame,
    target_col: str,
    feature_cols: Sequence[str] | None = None,
    categorical_cols: Sequence[str] | None = None,
    numerical_cols: Sequence[str] | None = None,
    scale: bool = True,
) -> tuple[DataFrame, list[str], dict]:
    """Label-encode categoricals, optionally standard-scale numericals.

    Returns the frame (keyed by ``row_id`` if present), the model feature column names and
    the fitted info (encoder mappings, scaler stats).
    """
    cats = list(categorical_cols if categorical_cols is not None else MODEL_CATEGORICAL)
    nums = list(numerical_cols if numerical_cols is not None else MODEL_NUMERIC)
    out, mappings = label_encode(df, cats)
    info: dict = {"encoders": mappings}
    if scale:
        stats = scaler_stats(out, nums, "standard")
        out = apply_scaler(out, nums, stats)
        info["scaler"] = stats
        info["scaled_cols"] = [f"{c}_Scaled" for c in nums]
    if feature_cols is not None:
        keep = [c for c in ["row_id", *feature_cols, target_col] if c in out.columns]
        out = out.select(*dict.fromkeys(keep))
    features = list(feature_cols) if feature_cols is not None else (
        [f"{c}_Scaled" for c in nums] if scale else nums) + [f"{c}_Encoded" for c in cats]
    return out, features, info


# ---------------------------------------------------------------- imputation / similarity matrix


def median_stats(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """One row: ``<col>`` = median of each column (unpivot, then one grouped quantile pass)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*")
    med = quantiles(long, "value", [0.5], by="column", exact=exact, few_groups=True)
    return med.agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in columns])


def impute_median(df: DataFrame, columns: Sequence[str], medians: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Fill nulls with the column medians (of ``df`` itself unless fitted ``medians`` given)."""
    med = medians if medians is not None else median_stats(df, columns, exact)
    med = med.select(*[F.col(c).alias(f"__m_{c}") for c in columns])
    joined = attach(df, med, [])
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in columns}) \
        .drop(*[f"__m_{c}" for c in columns])


def feature_matrix_stats(df: DataFrame, columns: Sequence[str] = RECOMMENDER_FEATURES, exact: bool = True) -> DataFrame:
    """One row with ``med_i, min_i, max_i`` per column (imputing a median moves neither min nor max)."""
    med = median_stats(df, columns, exact)
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"min_{i}") for i, c in enumerate(columns)],
                *[F.max(F.col(c).cast("double")).alias(f"max_{i}") for i, c in enumerate(columns)])
    return med.select(*[F.col(c).alias(f"med_{i}") for i, c in enumerate(columns)]).crossJoin(mm)


def apply_feature_matrix(df: DataFrame, stats: DataFrame, columns: Sequence[str] = RECOMMENDER_FEATURES,
                         prefix: str = "f") -> DataFrame:
    """Median-impute then min-max scale into ``f0..f{d-1}`` (constant column -> 0)."""
    joined = attach(df, stats, [])
    cols = {}
    for i, c in enumerate(columns):
        x = F.coalesce(F.col(c).cast("double"), F.col(f"med_{i}"))
        rng = F.col(f"max_{i}") - F.col(f"min_{i}")
        cols[f"{prefix}{i}"] = F.when(F.col(f"med_{i}").isNull(), F.lit(0.0)).otherwise(
            F.coalesce((x - F.col(f"min_{i}")) / F.nullif(rng, F.lit(0.0)), F.lit(0.0)))
    d = len(columns)
    return joined.withColumns(cols).drop(*[f"{p}_{i}" for p in ("med", "min", "max") for i in range(d)])


def feature_matrix(df: DataFrame, columns: Sequence[str] = RECOMMENDER_FEATURES, exact: bool = True) -> DataFrame:
    return apply_feature_matrix(df, feature_matrix_stats(df, columns, exact), columns)

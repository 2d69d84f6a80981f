"""Registered queries: ``name -> (spark callable, DuckDB SQL or None)``.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables. Computed
columns carry the same names on both sides. Doubles are rounded to 6 dp on both sides so
last-bit differences between engines do not matter. Queries without SQL (model fitting,
attributions) are registered in ``plans.ml_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import charts, explore, features, metrics, profile, quality
from ..operators.clean import (ACCEL, CC, FUEL, HP, MAKER, NAME, NUMERIC_COLUMNS, PRICE, SEATS, SPEED, TORQUE,
                               clean_dataset, complete_cases, remove_invalid_rows, trim_quantile)
from ..operators.features import (IS_ELECTRIC, IS_LUXURY, PERF_CATEGORY, POWER_TO_SPEED, PRICE_PER_HP,
                                  RECOMMENDER_FEATURES)
from ..operators.similar import Recommender, diversity
from ..sources.fixture import raw_specs
from ..sources.tables import read_table
from . import oracle as O
from .pipeline import specs

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

D = 6  # decimals every double is compared at


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r(c: str, decimals: int = D):
    return F.round(F.col(c).cast("double"), decimals).alias(c)


def sr(expr: str, name: str, decimals: int = D) -> str:
    return f"round({expr}, {decimals}) AS \"{name}\""


def cleaned(spark, sf_dir):
    return clean_dataset(raw_specs(spark, sf_dir))


# ================================================================ CLN: text -> typed columns


def _column_query(name: str, raw: str, out: str, spark_expr, sql_expr: str, rounded: bool = True):
    sql = O.with_specs(f"SELECT row_id, {sr(sql_expr, out) if rounded else sql_expr + ' AS ' + out} FROM raw_specs")

    @register(name, sql)
    def q(spark, sf_dir):
        c = spark_expr(F.col(raw))
        return raw_specs(spark, sf_dir).select("row_id", (F.round(c, D) if rounded else c).alias(out))
    return q


_column_query("clean_price", "cars_prices", PRICE, text.parse_price, O.price("cars_prices"))
_column_query("extract_numeric", "horsepower", "value", text.extract_numeric, O.num("horsepower"))
_column_query("clean_accel", "accel_0_100", ACCEL, text.parse_acceleration, O.accel("accel_0_100"))
_column_query("clean_hp", "horsepower", HP, text.parse_horsepower, O.hp("horsepower"))
_column_query("clean_torque", "torque", TORQUE, text.parse_torque, O.torque("torque"))
_column_query("clean_speed", "total_speed", SPEED, text.extract_numeric, O.num("total_speed"))
_column_query("clean_cc", "cc_battery", CC, text.extract_numeric, O.num("cc_battery"))
_column_query("clean_seats", "seats", SEATS, text.parse_seats, O.seats("seats"))
_column_query("fuel_class", "fuel_types", FUEL, text.fuel_class, O.fuel("fuel_types"), rounded=False)


@register("clean_names", O.with_specs("SELECT row_id, upper(trim(company_names)) AS Company_Clean, "
                                      "trim(cars_names) AS Car_Name_Clean FROM raw_specs"))
def q_clean_names(spark, sf_dir):
    return raw_specs(spark, sf_dir).select("row_id", text.normalize_maker("company_names").alias(MAKER),
                                           text.normalize_name("cars_names").alias(NAME))


_TYPED_NUM = [PRICE, HP, SPEED, ACCEL, TORQUE, CC, SEATS]


@register("clean_dataset", O.with_specs(
    "SELECT row_id, " + ", ".join(sr(c, c) for c in _TYPED_NUM) + f", {FUEL}, {MAKER}, {NAME} FROM cleaned"))
def q_clean_dataset(spark, sf_dir):
    return cleaned(spark, sf_dir).select("row_id", *[r(c) for c in _TYPED_NUM], FUEL, MAKER, NAME)


# ================================================================ FLT


@register("valid_rows", O.with_specs(f"SELECT row_id, {sr(PRICE, PRICE)} FROM valid"))
def q_valid_rows(spark, sf_dir):
    return remove_invalid_rows(cleaned(spark, sf_dir)).select("row_id", r(PRICE))


@register("complete_cases", O.with_specs(
    "SELECT row_id FROM specs WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in RECOMMENDER_FEATURES)))
def q_complete_cases(spark, sf_dir):
    return complete_cases(specs(spark, sf_dir), RECOMMENDER_FEATURES).select("row_id")


_BROWSE = explore.BROWSE_COLUMNS


@register("browse", O.with_specs(
    "SELECT row_id, " + ", ".join(sr(c, c) if c in _TYPED_NUM else c for c in _BROWSE) +
    f" FROM specs WHERE {MAKER} = 'FERRARI' AND {PRICE} BETWEEN 0 AND 500000 ORDER BY row_id LIMIT 50"))
def q_browse(spark, sf_dir):
    b = explore.browse(specs(spark, sf_dir), maker="FERRARI", price_min=0, price_max=500000, n=50)
    return b.select("row_id", *[r(c) if c in _TYPED_NUM else c for c in _BROWSE])


@register("trim_quantile", O.with_specs(
    f"SELECT row_id, {sr(PRICE, PRICE)} FROM specs WHERE {PRICE} <= (SELECT quantile_cont({PRICE}, 0.99) FROM specs)"))
def q_trim_quantile(spark, sf_dir):
    return trim_quantile(specs(spark, sf_dir), PRICE, 0.99).select("row_id", r(PRICE))


# ================================================================ FEA


@register("perf_category", O.with_specs(f"SELECT row_id, {PERF_CATEGORY} FROM specs"))
def q_perf_category(spark, sf_dir):
    df = remove_invalid_rows(cleaned(spark, sf_dir))
    return features.create_performance_category(df).select("row_id", PERF_CATEGORY)


@register("luxury_flag", O.with_specs(f"SELECT row_id, {MAKER}, {IS_LUXURY} FROM specs"))
def q_luxury(spark, sf_dir):
    df = remove_invalid_rows(cleaned(spark, sf_dir))
    return features.create_luxury_brand_feature(df).select("row_id", MAKER, IS_LUXURY)


@register("pipeline_features", O.with_specs(
    f"SELECT row_id, {PERF_CATEGORY}, {IS_LUXURY}, {sr(PRICE_PER_HP, PRICE_PER_HP)}, "
    f"{sr(POWER_TO_SPEED, POWER_TO_SPEED)}, {IS_ELECTRIC} FROM specs"))
def q_pipeline_features(spark, sf_dir):
    return specs(spark, sf_dir, written=False).select("row_id", PERF_CATEGORY, IS_LUXURY, r(PRICE_PER_HP), r(POWER_TO_SPEED),
                                       IS_ELECTRIC)


def _enc_sql(c: str) -> str:
    return (f"LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM "
            f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM specs WHERE {c} IS NOT NULL) d) e_{c} "
            f"ON CAST(s.{c} AS VARCHAR) = e_{c}.v")


@register("label_encode", O.with_specs(
    f"SELECT s.row_id, e_{MAKER}.code AS {MAKER}_Encoded, e_{FUEL}.code AS {FUEL}_Encoded "
    f"FROM specs s {_enc_sql(MAKER)} {_enc_sql(FUEL)}"))
def q_label_encode(spark, sf_dir):
    out, _ = features.label_encode(specs(spark, sf_dir), [MAKER, FUEL])
    return out.select("row_id", f"{MAKER}_Encoded", f"{FUEL}_Encoded")


@register("onehot", O.with_specs(
    "SELECT row_id, " + ", ".join(f"coalesce({FUEL} = '{v}', false) AS \"{FUEL}_{v}\"" for v in sorted(text.FUEL_CLASSES))
    + " FROM specs"))
def q_onehot(spark, sf_dir):
    out, names = features.one_hot(specs(spark, sf_dir), [FUEL])
    return out.select("row_id", *[F.col(f"`{n}`") for n in names[FUEL]])


@register("onehot_vectors", O.with_specs(
    f"SELECT row_id, CAST(code AS BIGINT) AS hot, CAST((SELECT count(DISTINCT {MAKER}) FROM specs) AS BIGINT) AS size FROM specs LEFT JOIN "
    f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {MAKER} AS v FROM specs WHERE {MAKER} IS NOT NULL)) "
    f"ON {MAKER} = v"))
def q_onehot_vectors(spark, sf_dir):
    """Makers as sparse vectors: the place that is one, and the length."""
    from pyspark.ml.functions import vector_to_array

    out, _ = features.one_hot_vectors(specs(spark, sf_dir), [MAKER])
    v = vector_to_array(F.col(f"{MAKER}_Vector"))
    hot = F.nullif(F.array_position(v, 1.0), F.lit(0)) - 1
    return out.select("row_id", hot.cast("bigint").alias("hot"), F.size(v).cast("bigint").alias("size"))


_SCALE_COLS = [HP, SPEED, ACCEL]


def _scale_sql(method: str) -> str:
    comp = " AND ".join(f"{c} IS NOT NULL" for c in _SCALE_COLS)
    if method == "standard":
        stats = ", ".join(f"avg({c}) AS c{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_SCALE_COLS))
    else:
        stats = ", ".join(f"min({c}) AS c{i}, max({c}) - min({c}) AS s{i}" for i, c in enumerate(_SCALE_COLS))
    cols = ", ".join(
        sr(f"CASE WHEN {comp} THEN ({c} - c{i}) / coalesce(nullif(s{i}, 0), 1) END", f"{c}_Scaled")
        for i, c in enumerate(_SCALE_COLS))
    return O.with_specs(f"SELECT row_id, {cols} FROM specs, st",
                        f"st AS (SELECT {stats} FROM specs WHERE {comp})")


@register("scale_standard", _scale_sql("standard"))
def q_scale_standard(spark, sf_dir):
    out = features.scale_numerical_features(specs(spark, sf_dir), _SCALE_COLS, "standard")
    return out.select("row_id", *[r(f"{c}_Scaled") for c in _SCALE_COLS])


@register("scale_minmax", _scale_sql("minmax"))
def q_scale_minmax(spark, sf_dir):
    out = features.scale_numerical_features(specs(spark, sf_dir), _SCALE_COLS, "minmax")
    return out.select("row_id", *[r(f"{c}_Scaled") for c in _SCALE_COLS])


_MODEL_NUM = features.MODEL_NUMERIC


@register("model_frame", O.with_specs(
    f"SELECT s.row_id, "
    + ", ".join(sr(f"CASE WHEN {' AND '.join(f's.{c} IS NOT NULL' for c in _MODEL_NUM)} THEN "
                   f"(s.{c} - c{i}) / coalesce(nullif(s{i}, 0), 1) END", f"{c}_Scaled") for i, c in enumerate(_MODEL_NUM))
    + f", e_{FUEL}.code AS {FUEL}_Encoded, e_{MAKER}.code AS {MAKER}_Encoded, {sr('s.' + PRICE, PRICE)} "
    f"FROM specs s {_enc_sql(FUEL)} {_enc_sql(MAKER)}, st",
    "st AS (SELECT " + ", ".join(f"avg({c}) AS c{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_MODEL_NUM))
    + " FROM specs WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _MODEL_NUM) + ")"))
def q_model_frame(spark, sf_dir):
    out, cols, _ = features.prepare_features_for_modeling(specs(spark, sf_dir), PRICE)
    return out.select("row_id", *[r(c) if c.endswith("_Scaled") else c for c in cols], r(PRICE))


def _fm_stats_sql(src: str = "specs") -> str:
    return "fm_stats AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS med_{i}, min({c}) AS min_{i}, max({c}) AS max_{i}"
        for i, c in enumerate(RECOMMENDER_FEATURES)) + f" FROM {src})"


def _fm_cols_sql(prefix: str = "") -> str:
    return ", ".join(
        f"coalesce((coalesce({prefix}{c}, med_{i}) - min_{i}) / nullif(max_{i} - min_{i}, 0), 0) AS f{i}"
        for i, c in enumerate(RECOMMENDER_FEATURES))


def _fm_sql() -> str:
    return (_fm_stats_sql() + f", fm AS (SELECT s.row_id, s.{MAKER}, s.{NAME}, s.{PRICE}, "
            + ", ".join(f"s.{c} AS raw_{i}" for i, c in enumerate(RECOMMENDER_FEATURES))
            + f", {_fm_cols_sql('s.')} FROM specs s, fm_stats)")


@register("feature_matrix", O.with_specs(
    "SELECT row_id, " + ", ".join(sr(f"f{i}", f"f{i}") for i in range(len(RECOMMENDER_FEATURES))) + " FROM fm",
    _fm_sql()))
def q_feature_matrix(spark, sf_dir):
    out = features.feature_matrix(specs(spark, sf_dir))
    return out.select("row_id", *[r(f"f{i}") for i in range(len(RECOMMENDER_FEATURES))])


@register("impute_median", O.with_specs(
    "SELECT row_id, " + ", ".join(sr(f"coalesce({c}, med_{i})", c) for i, c in enumerate(RECOMMENDER_FEATURES))
    + " FROM specs, fm_stats", _fm_stats_sql()))
def q_impute_median(spark, sf_dir):
    out = features.impute_median(specs(spark, sf_dir), RECOMMENDER_FEATURES)
    return out.select("row_id", *[r(c) for c in RECOMMENDER_FEATURES])


# ================================================================ PRF


_STAT_COLS = [*NUMERIC_COLUMNS, PRICE_PER_HP, POWER_TO_SPEED]


def _basic_stats_sql(cols, src: str) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, {sr(f'avg({x})', 'mean')}, "
            f"{sr(f'stddev_samp({x})', 'std')}, {sr(f'min({x})', 'min')}, "
            f"{sr(f'quantile_cont({x}, 0.25)', 'q25')}, {sr(f'quantile_cont({x}, 0.5)', 'q50')}, "
            f"{sr(f'quantile_cont({x}, 0.75)', 'q75')}, {sr(f'max({x})', 'max')}, "
            f"count(*) - count({x}) AS missing, round((count(*) - count({x})) / count(*) * 100, 2) AS missing_pct "
            f"FROM {src}")
    return " UNION ALL ".join(parts)


@register("basic_stats", O.with_specs(_basic_stats_sql(_STAT_COLS, "specs")))
def q_basic_stats(spark, sf_dir):
    return profile.basic_statistics(specs(spark, sf_dir), _STAT_COLS, decimals=D)


_CAT_COLS = [FUEL, PERF_CATEGORY, MAKER]


@register("categorical_summary", O.with_specs(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count, "
    f"round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage FROM specs WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _CAT_COLS)))
def q_categorical_summary(spark, sf_dir):
    return profile.categorical_summary(specs(spark, sf_dir), _CAT_COLS)


@register("price_distribution", O.with_specs(
    f"SELECT {sr('avg(x)', 'mean')}, {sr('quantile_cont(x, 0.5)', 'median')}, {sr('stddev_samp(x)', 'std')}, "
    f"{sr('min(x)', 'min')}, {sr('max(x)', 'max')}, {sr('quantile_cont(x, 0.25)', 'q25')}, "
    f"{sr('quantile_cont(x, 0.75)', 'q75')}, {sr('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr')}, "
    f"{sr('skewness(x)', 'skewness')}, {sr('kurtosis(x)', 'kurtosis')}, count(x) AS count "
    f"FROM (SELECT {PRICE} AS x FROM specs WHERE {PRICE} IS NOT NULL)"))
def q_price_distribution(spark, sf_dir):
    return profile.price_distribution(specs(spark, sf_dir), decimals=D)


@register("price_segments", O.with_specs(
    f"SELECT count_if({PRICE} < 30000) AS budget, count_if({PRICE} >= 30000 AND {PRICE} < 100000) AS mid_range, "
    f"count_if({PRICE} >= 100000 AND {PRICE} < 500000) AS premium, count_if({PRICE} >= 500000) AS luxury FROM specs"))
def q_price_segments(spark, sf_dir):
    return profile.price_segments(specs(spark, sf_dir))


@register("by_brand", O.with_specs(f"""
SELECT Company_Clean, count(Price_USD) AS car_count, round(avg(Price_USD), 6) AS avg_price,
       round(quantile_cont(Price_USD, 0.5), 6) AS median_price, round(min(Price_USD), 6) AS min_price,
       round(max(Price_USD), 6) AS max_price, round(avg(HorsePower_Numeric), 6) AS avg_hp,
       round(max(HorsePower_Numeric), 6) AS max_hp
FROM specs WHERE Company_Clean IS NOT NULL GROUP BY Company_Clean
"""))
def q_by_brand(spark, sf_dir):
    return profile.by_brand(specs(spark, sf_dir), decimals=D)


@register("by_fuel", O.with_specs(
    f"SELECT {FUEL}, " + ", ".join(f"count({c}) AS {c}_count, {sr(f'avg({c})', c + '_mean')}" for c in (PRICE, HP, ACCEL))
    + f" FROM specs WHERE {FUEL} IS NOT NULL GROUP BY {FUEL}"))
def q_by_fuel(spark, sf_dir):
    return profile.by_fuel_type(specs(spark, sf_dir), decimals=D)


def _corr_sql(cols, src: str, lower: bool = False) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if lower and i <= j:
                continue
            x, y = (a, b) if i <= j else (b, a)
            parts.append(f"SELECT '{a}' AS \"row\", '{b}' AS col, {sr(f'corr({x}, {y})', 'corr')} FROM {src}")
    return " UNION ALL ".join(parts)


_CORR_COLS = RECOMMENDER_FEATURES


@register("corr_matrix", O.with_specs(_corr_sql(_CORR_COLS, "specs")))
def q_corr_matrix(spark, sf_dir):
    return profile.correlation_matrix(specs(spark, sf_dir), _CORR_COLS, decimals=D)


_IQR_CTE = (f"b AS (SELECT quantile_cont({PRICE}, 0.25) - 1.5 * (quantile_cont({PRICE}, 0.75) - quantile_cont({PRICE}, 0.25)) AS lo, "
            f"quantile_cont({PRICE}, 0.75) + 1.5 * (quantile_cont({PRICE}, 0.75) - quantile_cont({PRICE}, 0.25)) AS hi FROM specs)")


@register("outliers_iqr", O.with_specs(
    f"SELECT row_id, {sr(PRICE, PRICE)} FROM specs, b WHERE {PRICE} < lo OR {PRICE} > hi", _IQR_CTE))
def q_outliers_iqr(spark, sf_dir):
    return profile.identify_outliers(specs(spark, sf_dir), PRICE, "iqr", 1.5).select("row_id", r(PRICE))


@register("outlier_stats", O.with_specs(
    f"SELECT count_if({PRICE} < lo OR {PRICE} > hi) AS total_outliers, "
    f"{sr(f'count_if({PRICE} < lo OR {PRICE} > hi) / count(*) * 100', 'outlier_percentage')}, "
    f"{sr('lo', 'lower_bound')}, {sr('hi', 'upper_bound')} FROM specs, b GROUP BY lo, hi", _IQR_CTE))
def q_outlier_stats(spark, sf_dir):
    o = profile.outlier_stats(specs(spark, sf_dir), PRICE, "iqr", 1.5)
    return o.select("total_outliers", r("outlier_percentage"), r("lower_bound"), r("upper_bound"))


@register("outliers_zscore", O.with_specs(
    f"SELECT row_id, {sr(PRICE, PRICE)} FROM specs, z WHERE abs(({PRICE} - m) / nullif(s, 0)) > 3",
    f"z AS (SELECT avg({PRICE}) AS m, stddev_samp({PRICE}) AS s FROM specs)"))
def q_outliers_zscore(spark, sf_dir):
    return profile.identify_outliers(specs(spark, sf_dir), PRICE, "zscore", 3.0).select("row_id", r(PRICE))


@register("perf_vs_price", O.with_specs(
    f"SELECT category, {sr(f'avg({PRICE})', 'mean')}, {sr(f'quantile_cont({PRICE}, 0.5)', 'median')}, "
    f"count({PRICE}) AS count, {sr('(SELECT corr(' + ACCEL + ', ' + PRICE + ') FROM v)', 'correlation')} "
    f"FROM v GROUP BY category",
    f"v AS (SELECT *, CASE WHEN {ACCEL} < 4.5 THEN 'High-Performance' WHEN {ACCEL} <= 8.0 THEN 'Mid-Range' "
    f"ELSE 'Economy' END AS category FROM specs WHERE {ACCEL} IS NOT NULL AND {PRICE} IS NOT NULL)"))
def q_perf_vs_price(spark, sf_dir):
    return profile.performance_vs_price(specs(spark, sf_dir), decimals=D)


# ================================================================ QLT


_RAW_NO_ID = ["company_names", "cars_names", "engines", "cc_battery", "horsepower", "total_speed",
              "accel_0_100", "cars_prices", "fuel_types", "seats", "torque"]
_SPEC_NO_NAME = [c for c in _RAW_NO_ID if c != "cars_names"]


@register("validate_counts", O.with_specs(
    "SELECT count(*) AS total_rows, count(DISTINCT company_names) AS unique_companies, "
    "count(DISTINCT fuel_types) AS unique_fuel_types, 11 AS total_columns, "
    f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM raw_specs GROUP BY {', '.join(_RAW_NO_ID)})) "
    "AS duplicates FROM raw_specs"))
def q_validate_counts(spark, sf_dir):
    return quality.validate_counts(raw_specs(spark, sf_dir).drop("row_id")).select(
        "total_rows", "unique_companies", "unique_fuel_types", F.col("total_columns").cast("int"), "duplicates")


@register("duplicate_rows", O.with_specs(
    f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM raw_specs "
    f"GROUP BY {', '.join(_SPEC_NO_NAME)})"))
def q_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(raw_specs(spark, sf_dir), _SPEC_NO_NAME)


def _issue_text_sql(m: str, n: str) -> str:
    fl = f"({m} * 1000 // {n})"
    rem2 = f"(({m} * 1000 - {fl} * {n}) * 2)"
    tenths = (f"CAST({fl} + CASE WHEN {rem2} > {n} THEN 1 WHEN {rem2} = {n} AND {fl} % 2 = 1 THEN 1 ELSE 0 END "
              "AS BIGINT)")
    return (f"'Column ''' || \"column\" || ''' has ' || CAST({m} AS VARCHAR) || ' missing values (' || "
            f"CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || '%)'")


def _issues_sql() -> str:
    cols = ["row_id", *_RAW_NO_ID, PRICE, HP, SPEED, ACCEL, TORQUE, CC, SEATS, FUEL, MAKER, NAME]
    mv = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM cleaned"
                            for c in cols)
    return O.with_specs(f"SELECT \"column\", missing, {_issue_text_sql('missing', 'n')} AS issue FROM ({mv}) "
                        f"WHERE missing > n * 0.1")


@register("validate_issues", _issues_sql())
def q_validate_issues(spark, sf_dir):
    return quality.validate_issues(cleaned(spark, sf_dir))


def _column_summary_sql() -> str:
    types = {"row_id": "bigint"}
    parts = []
    for c in ["row_id", *_RAW_NO_ID]:
        v = f"CAST({c} AS VARCHAR)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS dtype, count({c}) AS non_null_count, "
            f"count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage, "
            f"count(DISTINCT {c}) AS unique_values, arg_min_null({v}, row_id) AS sample_value FROM raw_specs")
    return O.with_specs(" UNION ALL ".join(parts))


@register("column_summary", _column_summary_sql())
def q_column_summary(spark, sf_dir):
    return quality.column_summary(raw_specs(spark, sf_dir))


# ================================================================ DSH


@register("overview", O.with_specs(
    f"SELECT count(*) AS total_cars, count(DISTINCT {MAKER}) AS manufacturers, {sr(f'avg({PRICE})', 'average_price')}, "
    f"{sr(f'avg({HP})', 'average_hp')} FROM specs"))
def q_overview(spark, sf_dir):
    return explore.overview(specs(spark, sf_dir)).select("total_cars", "manufacturers", r("average_price"),
                                                        r("average_hp"))


@register("category_share", O.with_specs(
    f"SELECT {PERF_CATEGORY}, count(*) AS count, {sr('count(*) / (SELECT count(*) FROM specs) * 100', 'percentage')} "
    f"FROM specs WHERE {PERF_CATEGORY} IS NOT NULL GROUP BY {PERF_CATEGORY}"))
def q_category_share(spark, sf_dir):
    return explore.category_share(specs(spark, sf_dir), decimals=D)


@register("top_brands", O.with_specs(
    f"SELECT {MAKER}, {sr(f'avg({PRICE})', 'mean')}, count({PRICE}) AS count FROM specs WHERE {MAKER} IS NOT NULL "
    f"GROUP BY {MAKER} HAVING count({PRICE}) >= 10 ORDER BY avg({PRICE}) DESC, {MAKER} LIMIT 10"))
def q_top_brands(spark, sf_dir):
    return explore.top_groups_by_mean(specs(spark, sf_dir), MAKER, PRICE, 10, 10).select(MAKER, r("mean"), "count")


_MEAN_COLS = [PRICE, HP, SPEED, ACCEL]


@register("category_means", O.with_specs(
    f"SELECT {PERF_CATEGORY}, " + ", ".join(sr(f"avg({c})", f"avg_{c}") for c in _MEAN_COLS)
    + f" FROM specs WHERE {PERF_CATEGORY} IS NOT NULL GROUP BY {PERF_CATEGORY}"))
def q_category_means(spark, sf_dir):
    return explore.group_means(specs(spark, sf_dir), PERF_CATEGORY, _MEAN_COLS, decimals=D)


_LEADER = explore.LEADER_COLUMNS


@register("fastest_per_category", O.with_specs(
    f"SELECT {PERF_CATEGORY}, " + ", ".join(sr(c, c) if c in _TYPED_NUM else c for c in _LEADER)
    + f", row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY {PERF_CATEGORY} ORDER BY {ACCEL}, row_id) AS rank "
    f"FROM specs WHERE {ACCEL} IS NOT NULL AND {PERF_CATEGORY} IN ('High-Performance', 'Mid-Range', 'Economy')) "
    f"WHERE rank <= 5"))
def q_fastest(spark, sf_dir):
    out = explore.smallest_per_group(specs(spark, sf_dir), PERF_CATEGORY, ACCEL, 5)
    return out.select(PERF_CATEGORY, *[r(c) if c in _TYPED_NUM else c for c in _LEADER], "row_id",
                      F.col("rank").cast("bigint").alias("rank"))


@register("filter_choices", O.with_specs(
    f"SELECT DISTINCT 'maker' AS choice, {MAKER} AS value FROM specs WHERE {MAKER} IS NOT NULL UNION ALL "
    f"SELECT DISTINCT 'category', {PERF_CATEGORY} FROM specs WHERE {PERF_CATEGORY} IS NOT NULL UNION ALL "
    f"SELECT 'max_price', CAST(CAST(floor(max({PRICE})) AS BIGINT) AS VARCHAR) FROM specs"))
def q_filter_choices(spark, sf_dir):
    return explore.filter_choices(specs(spark, sf_dir))


@register("label_lookup", O.with_specs(
    f"SELECT {MAKER} || ' ' || {NAME} AS label, min(row_id) AS row_id, count(*) AS matches FROM specs "
    f"WHERE {MAKER} || ' ' || {NAME} IS NOT NULL GROUP BY 1"))
def q_label_lookup(spark, sf_dir):
    return explore.lookup_labels(specs(spark, sf_dir))


# ================================================================ CHT


def _q(col: str, p: float, src: str = "specs") -> str:
    return f"(SELECT quantile_cont({col}, {p}) FROM {src} WHERE {col} IS NOT NULL)"


def _hist_sql(col: str, src_cte: str, bins: int, trim: float | None) -> str:
    flt = f"WHERE x <= {_q('x', trim, 'hx0')}" if trim is not None else ""
    return (
        f"hx0 AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src_cte} WHERE {col} IS NOT NULL), "
        f"hx AS (SELECT x FROM hx0 {flt}), "
        "hr0 AS (SELECT min(x) AS lo, max(x) AS hi FROM hx), "
        "hr AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM hr0), "
        f"hc AS (SELECT CAST(least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS c FROM hx, hr GROUP BY 1)",
        f"SELECT CAST(b.bin AS INTEGER) AS bin, {sr(f'lo + (hi - lo) * b.bin / {bins}', 'lower')}, "
        f"{sr(f'lo + (hi - lo) * (b.bin + 1) / {bins}', 'upper')}, CAST(coalesce(c, 0) AS BIGINT) AS count "
        f"FROM (SELECT range AS bin FROM range({bins})) b CROSS JOIN hr LEFT JOIN hc ON b.bin = hc.bin")


def _hist_query(name: str, table_fn, col: str, src_sql_ctes: str | None, src_name: str, bins: int, trim):
    ctes, body = _hist_sql(col, src_name, bins, trim)
    if src_sql_ctes is None:
        sql = O.with_specs(body, ctes)
    else:
        sql = f"WITH {src_sql_ctes}{', ' if src_sql_ctes else ''}{ctes} {body}"

    @register(name, sql)
    def q(spark, sf_dir):
        h = charts.histogram(table_fn(spark, sf_dir), col, bins, trim)
        return h.select("bin", r("lower"), r("upper"), "count")
    return q


_hist_query("hist_price", specs, PRICE, None, "specs", 50, 0.99)
_hist_query("hist_lineitem", lambda s, d: read_table(s, d, "lineitem"), "l_extendedprice", "", "lineitem", 50, 0.99)
_hist_query("hist_events", lambda s, d: read_table(s, d, "events"), "value", "", "events", 40, 0.95)


def _box_sql(col: str, src: str, by: str | None = None, trim: float | None = None) -> tuple[str, str]:
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    j = f"USING ({by})" if by else "ON true"
    flt = f" AND {col} <= {_q(col, trim, src)}" if trim is not None else ""
    nn = f" AND {by} IS NOT NULL" if by else ""
    ctes = (f"bx AS (SELECT {k}CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL{flt}{nn}), "
            f"bq AS (SELECT {k}count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, "
            f"quantile_cont(x, 0.75) AS q3 FROM bx {g})")
    inside = "x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)"
    body = (f"SELECT {k}n, {sr('q1', 'q1')}, {sr('median', 'median')}, {sr('q3', 'q3')}, "
            f"{sr(f'min(CASE WHEN {inside} THEN x END)', 'whisker_low')}, "
            f"{sr(f'max(CASE WHEN {inside} THEN x END)', 'whisker_high')}, count_if(NOT ({inside})) AS outliers "
            f"FROM bx JOIN bq {j} GROUP BY {k}n, q1, median, q3")
    return ctes, body


def _box_cols(by: list[str]):
    return [*by, "n", r("q1"), r("median"), r("q3"), r("whisker_low"), r("whisker_high"), "outliers"]


@register("box_price", O.with_specs(_box_sql(PRICE, "specs", None, 0.99)[1], _box_sql(PRICE, "specs", None, 0.99)[0]))
def q_box_price(spark, sf_dir):
    return charts.box_summary(specs(spark, sf_dir), PRICE, trim_q=0.99).select(*_box_cols([]))


_c, _b = _box_sql("value", "events", "event_type")


@register("box_events_by_type", f"WITH {_c} {_b}")
def q_box_events(spark, sf_dir):
    return charts.box_summary(read_table(spark, sf_dir, "events"), "value", by="event_type").select(
        *_box_cols(["event_type"]))


_c, _b = _box_sql(PRICE, "topk", MAKER)


@register("brand_box", O.with_specs(
    _b, f"topk AS (SELECT * FROM specs WHERE {MAKER} IN (SELECT {MAKER} FROM specs WHERE {MAKER} IS NOT NULL "
        f"GROUP BY {MAKER} ORDER BY count(*) DESC, {MAKER} LIMIT 15)), {_c}"))
def q_brand_box(spark, sf_dir):
    return charts.top_group_box(specs(spark, sf_dir), MAKER, PRICE, 15).select(*_box_cols([MAKER]))


@register("corr_lower", O.with_specs(_corr_sql(_CORR_COLS, "specs", lower=True)))
def q_corr_lower(spark, sf_dir):
    return charts.corr_lower(specs(spark, sf_dir), _CORR_COLS, decimals=D)


_LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_lineitem", "WITH x AS (SELECT 1) " + _corr_sql(_LI_CORR, "lineitem"))
def q_corr_lineitem(spark, sf_dir):
    return profile.correlation_matrix(read_table(spark, sf_dir, "lineitem"), _LI_CORR, decimals=D)


@register("fuel_share", O.with_specs(
    f"SELECT {FUEL}, count(*) AS count, {sr(f'count(*) / sum(count(*)) OVER () * 100', 'percentage')} "
    f"FROM specs WHERE {FUEL} IS NOT NULL GROUP BY {FUEL}"))
def q_fuel_share(spark, sf_dir):
    return charts.value_share(specs(spark, sf_dir), FUEL, decimals=D)


@register("scatter_perf", O.with_specs(
    f"SELECT row_id, {sr(ACCEL, ACCEL)}, {sr(SPEED, SPEED)}, {sr(PRICE, PRICE)} FROM c "
    f"WHERE {PRICE} <= (SELECT quantile_cont({PRICE}, 0.95) FROM c)",
    f"c AS (SELECT * FROM specs WHERE {ACCEL} IS NOT NULL AND {SPEED} IS NOT NULL AND {PRICE} IS NOT NULL)"))
def q_scatter_perf(spark, sf_dir):
    return charts.scatter_set(specs(spark, sf_dir), ACCEL, SPEED, PRICE, 0.95).select(
        "row_id", r(ACCEL), r(SPEED), r(PRICE))


@register("trend_hp_price", O.with_specs(
    f"SELECT count(*) AS n, {sr(f'regr_slope({PRICE}, {HP})', 'slope')}, {sr(f'regr_intercept({PRICE}, {HP})', 'intercept')}, "
    f"{sr(f'corr({HP}, {PRICE})', 'correlation')} FROM c WHERE {PRICE} <= (SELECT quantile_cont({PRICE}, 0.95) FROM c)",
    f"c AS (SELECT * FROM specs WHERE {HP} IS NOT NULL AND {PRICE} IS NOT NULL)"))
def q_trend(spark, sf_dir):
    return charts.trend_line(specs(spark, sf_dir), HP, PRICE, 0.95).select(
        "n", r("slope"), r("intercept"), r("correlation"))


@register("category_counts", O.with_specs(
    f"SELECT position, d.{PERF_CATEGORY}, CAST(coalesce(c, 0) AS BIGINT) AS count FROM "
    f"(VALUES (0, 'High-Performance'), (1, 'Mid-Range'), (2, 'Economy')) d(position, {PERF_CATEGORY}) "
    f"LEFT JOIN (SELECT {PERF_CATEGORY}, count(*) AS c FROM specs GROUP BY 1) s USING ({PERF_CATEGORY})"))
def q_category_counts(spark, sf_dir):
    return charts.ordered_counts(specs(spark, sf_dir))


@register("scatter_category", O.with_specs(
    f"SELECT row_id, {sr(HP, HP)}, {sr(PRICE, PRICE)}, {PERF_CATEGORY} FROM specs "
    f"WHERE {PRICE} <= {_q(PRICE, 0.95)} AND {PERF_CATEGORY} IN ('High-Performance', 'Mid-Range', 'Economy')"))
def q_scatter_category(spark, sf_dir):
    return charts.scatter_by_category(specs(spark, sf_dir)).select("row_id", r(HP), r(PRICE), PERF_CATEGORY)


# ================================================================ metrics on fixed predictions


_CM_SQL = (
    "WITH cells AS (SELECT a.p AS actual_pos, a.v AS actual, b.p AS predicted_pos, b.v AS predicted FROM "
    "(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS p FROM (SELECT quality AS v FROM labels "
    "UNION SELECT toxic FROM labels)) a, "
    "(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS p FROM (SELECT quality AS v FROM labels "
    "UNION SELECT toxic FROM labels)) b), "
    "cnt AS (SELECT quality AS actual, toxic AS predicted, count(*) AS c FROM labels GROUP BY 1, 2), "
    "cm AS (SELECT actual_pos, actual, predicted_pos, predicted, CAST(coalesce(c, 0) AS BIGINT) AS count "
    "FROM cells LEFT JOIN cnt USING (actual, predicted))")


@register("confusion", _CM_SQL + " SELECT * FROM cm")
def q_confusion(spark, sf_dir):
    return metrics.confusion(read_table(spark, sf_dir, "labels"), "quality", "toxic")


_REPORT_SQL = _CM_SQL + (
    ", pc AS (SELECT d.actual_pos AS pos, CAST(d.actual AS VARCHAR) AS label, "
    "coalesce(d.count / nullif(p.pn, 0), 0) AS precision, coalesce(d.count / nullif(s.sup, 0), 0) AS recall, "
    "s.sup AS support, d.count AS tp FROM cm d "
    "JOIN (SELECT actual_pos, sum(count) AS sup FROM cm GROUP BY 1) s ON s.actual_pos = d.actual_pos "
    "JOIN (SELECT predicted_pos, sum(count) AS pn FROM cm GROUP BY 1) p ON p.predicted_pos = d.actual_pos "
    "WHERE d.actual_pos = d.predicted_pos), "
    "pcf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc), "
    "rep AS (SELECT pos, label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pcf "
    "UNION ALL SELECT count(*), 'accuracy', NULL, NULL, coalesce(sum(tp) / nullif(sum(support), 0), 0), sum(support) FROM pcf "
    "UNION ALL SELECT count(*) + 1, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pcf "
    "UNION ALL SELECT count(*) + 2, 'weighted avg', sum(precision * support) / nullif(sum(support), 0), "
    "sum(recall * support) / nullif(sum(support), 0), sum(f1 * support) / nullif(sum(support), 0), sum(support) FROM pcf)")


@register("clf_report", _REPORT_SQL + " SELECT CAST(pos AS INTEGER) AS pos, label, round(precision, 6) AS precision, "
          "round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep")
def q_clf_report(spark, sf_dir):
    rep = metrics.classification_report(read_table(spark, sf_dir, "labels"), "quality", "toxic")
    return rep.select("pos", "label", r("precision"), r("recall"), r("f1"), "support")


@register("clf_metrics", _REPORT_SQL + " SELECT round(a.f1, 6) AS accuracy, round(w.precision, 6) AS precision_weighted, "
          "round(w.recall, 6) AS recall_weighted, round(w.f1, 6) AS f1_weighted FROM rep a, rep w "
          "WHERE a.label = 'accuracy' AND w.label = 'weighted avg'")
def q_clf_metrics(spark, sf_dir):
    m = metrics.classification_metrics(read_table(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select(r("accuracy"), r("precision_weighted"), r("recall_weighted"), r("f1_weighted"))


@register("reg_metrics", (
    "SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, "
    "round(CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum(e * e) / (var_pop(y) * count(*)) END, 6) AS r2, "
    "round(CASE WHEN count_if(y = 0) = 0 THEN avg(abs(e / y)) * 100 END, 6) AS mape, count(*) AS n "
    "FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_extendedprice AS DOUBLE) - CAST(l_quantity AS DOUBLE) * 950.0 AS e "
    "FROM lineitem)"))
def q_reg_metrics(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", (F.col("l_quantity").cast("double") * 950.0).alias("pred"))
    m = metrics.regression_metrics(li, "l_extendedprice", "pred")
    return m.select(r("rmse"), r("mae"), r("r2"), r("mape"), "n")


@register("strat_split", (
    "SELECT quality, v AS is_validation, CASE WHEN v THEN k ELSE n - k END AS count FROM "
    "(SELECT quality, count(*) AS n, CAST(round(0.2 * count(*)) AS BIGINT) AS k FROM labels GROUP BY quality), "
    "(VALUES (true), (false)) t(v)"))
def q_strat_split(spark, sf_dir):
    s = metrics.stratified_split(read_table(spark, sf_dir, "labels"), "quality", 0.2, 42, "doc_id")
    return s.groupBy("quality", "is_validation").agg(F.count(F.lit(1)).alias("count"))


@register("strat_folds", (
    "SELECT quality, CAST(j AS INTEGER) AS fold, CAST(round((j + 1) * n / 5.0) - round(j * n / 5.0) AS BIGINT) AS count FROM "
    "(SELECT quality, count(*) AS n FROM labels GROUP BY quality), (SELECT range AS j FROM range(5))"))
def q_strat_folds(spark, sf_dir):
    s = metrics.stratified_folds(read_table(spark, sf_dir, "labels"), "quality", 5, 42, "doc_id")
    return s.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("count"))


@register("balanced_weights", (
    "SELECT doc_id, quality, round(n / (k * nc), 6) AS weight FROM labels JOIN "
    "(SELECT quality, count(*) AS nc FROM labels GROUP BY quality) USING (quality), "
    "(SELECT count(*) AS n, count(DISTINCT quality) AS k FROM labels)"))
def q_balanced_weights(spark, sf_dir):
    w = metrics.balanced_weights(read_table(spark, sf_dir, "labels"), "quality")
    return w.select("doc_id", "quality", r("weight"))


# ================================================================ REC


def _recommender(spark, sf_dir) -> Recommender:
    return Recommender().fit(specs(spark, sf_dir))


_REC_OUT = f"target_id, rank, row_id, {MAKER}, {NAME}, round({PRICE}, 6) AS {PRICE}, similarity_score"
_DOT = " + ".join(f"fm.f{i} * t.t{i}" for i in range(len(RECOMMENDER_FEATURES)))
_NA = "sqrt(" + " + ".join(f"fm.f{i} * fm.f{i}" for i in range(len(RECOMMENDER_FEATURES))) + ")"
_NB = "sqrt(" + " + ".join(f"t.t{i} * t.t{i}" for i in range(len(RECOMMENDER_FEATURES))) + ")"
_SIM = f"round(coalesce(({_DOT}) / nullif({_NA} * {_NB}, 0), 0), 9)"


def _rec_sql(target_cte: str, where: str) -> str:
    return O.with_specs(
        f"SELECT {_REC_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY similarity_score DESC, row_id) "
        f"AS rank FROM (SELECT fm.*, t.target_id, {_SIM} AS similarity_score FROM fm, t WHERE {where})) WHERE rank <= 5",
        _fm_sql() + ", " + target_cte)


_T_FIRST = ("t AS (SELECT row_id AS target_id, " + MAKER + " AS target_maker, "
            + ", ".join(f"f{i} AS t{i}" for i in range(len(RECOMMENDER_FEATURES)))
            + " FROM fm WHERE row_id = (SELECT min(row_id) FROM fm))")


def _first_id(spark, sf_dir) -> int:
    """The lowest id of the catalogue (a one-row aggregate)."""
    return specs(spark, sf_dir).agg(F.min("row_id")).first()[0]


def _rec_cols(df):
    return df.select("target_id", F.col("rank").cast("bigint").alias("rank"), "row_id", MAKER, NAME, r(PRICE),
                     "similarity_score")


@register("similar_items", _rec_sql(_T_FIRST, "fm.row_id <> t.target_id"))
def q_similar_items(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    first = rec.matrix.agg(F.min("row_id").alias("target_id"))
    return _rec_cols(rec._rank(rec._targets_by_id(first), 5, True, False))


@register("similar_other_brand", _rec_sql(
    _T_FIRST, f"fm.row_id <> t.target_id AND fm.{MAKER} IS DISTINCT FROM t.target_maker"))
def q_similar_other_brand(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    first = rec.matrix.agg(F.min("row_id").alias("target_id"))
    return _rec_cols(rec._rank(rec._targets_by_id(first), 5, True, True))


_NAME_TEXT = "blue"


@register("similar_by_name", _rec_sql(
    "t AS (SELECT row_id AS target_id, " + MAKER + " AS target_maker, "
    + ", ".join(f"f{i} AS t{i}" for i in range(len(RECOMMENDER_FEATURES)))
    + f" FROM fm WHERE row_id = (SELECT min(row_id) FROM fm WHERE contains(lower({NAME}), '{_NAME_TEXT}')))",
    "fm.row_id <> t.target_id"))
def q_similar_by_name(spark, sf_dir):
    return _rec_cols(_recommender(spark, sf_dir).similar_by_name(_NAME_TEXT, 5))


_SPEC = {HP: 500.0, PRICE: 100000.0}


def _spec_target_sql() -> str:
    cols = []
    for i, c in enumerate(RECOMMENDER_FEATURES):
        x = repr(_SPEC[c]) if c in _SPEC else f"med_{i}"
        cols.append(f"coalesce(({x} - min_{i}) / nullif(max_{i} - min_{i}, 0), 0) AS t{i}")
    return "t AS (SELECT CAST(-1 AS BIGINT) AS target_id, CAST(NULL AS VARCHAR) AS target_maker, " + ", ".join(cols) + " FROM fm_stats)"


@register("similar_by_specs", _rec_sql(_spec_target_sql(), "true"))
def q_similar_by_specs(spark, sf_dir):
    return _rec_cols(_recommender(spark, sf_dir).similar_by_specs(_SPEC, 5))


@register("rec_diversity", _rec_sql(_T_FIRST, "fm.row_id <> t.target_id").replace(
    f"SELECT {_REC_OUT} FROM", f"SELECT target_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE (count(DISTINCT {MAKER}) / count(*) "
    f"+ least((max({PRICE}) - min({PRICE})) / (avg({PRICE}) + 1e-6), 1)) / 2 END, 6) AS diversity FROM", 1)
    .removesuffix("WHERE rank <= 5") + "WHERE rank <= 5 GROUP BY target_id")
def q_rec_diversity(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    first = rec.matrix.agg(F.min("row_id").alias("target_id"))
    return diversity(rec._rank(rec._targets_by_id(first), 5, True, False)).select("target_id", r("diversity"))


_T_ALL = ("t AS (SELECT row_id AS target_id, " + MAKER + " AS target_maker, "
          + ", ".join(f"f{i} AS t{i}" for i in range(len(RECOMMENDER_FEATURES))) + " FROM fm)")


@register("similar_items_all", _rec_sql(_T_ALL, "fm.row_id <> t.target_id"))
def q_similar_items_all(spark, sf_dir):
    """The five most similar items of every item."""
    return _rec_cols(_recommender(spark, sf_dir).similar_many(n=5))


@register("similar_other_brand_all", _rec_sql(
    _T_ALL, f"fm.row_id <> t.target_id AND fm.{MAKER} IS DISTINCT FROM t.target_maker"))
def q_similar_other_brand_all(spark, sf_dir):
    return _rec_cols(_recommender(spark, sf_dir).similar_many(n=5, exclude_same_brand=True))


@register("rec_diversity_all", _rec_sql(_T_ALL, "fm.row_id <> t.target_id").replace(
    f"SELECT {_REC_OUT} FROM", f"SELECT target_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE (count(DISTINCT {MAKER}) / count(*) "
    f"+ least((max({PRICE}) - min({PRICE})) / (avg({PRICE}) + 1e-6), 1)) / 2 END, 6) AS diversity FROM", 1)
    .removesuffix("WHERE rank <= 5") + "WHERE rank <= 5 GROUP BY target_id")
def q_rec_diversity_all(spark, sf_dir):
    """Diversity of every item's list."""
    return diversity(_recommender(spark, sf_dir).similar_many(n=5)).select("target_id", r("diversity"))


@register("rec_coverage", O.with_specs(
    "SELECT round(coalesce(avg(CASE WHEN " + " AND ".join(f"f{i} IS NOT NULL" for i in range(len(RECOMMENDER_FEATURES)))
    + " THEN 1.0 ELSE 0.0 END), 0), 6) AS coverage FROM fm", _fm_sql()))
def q_rec_coverage(spark, sf_dir):
    return _recommender(spark, sf_dir).coverage().select(r("coverage"))


_EXPLAIN_PAIR = _rec_sql(_T_FIRST, "fm.row_id <> t.target_id").replace(
    f"SELECT {_REC_OUT} FROM", "SELECT target_id AS source_id, row_id AS target_id FROM", 1).replace(
    "WHERE rank <= 5", "WHERE rank = 1")


def _rec_explain_sql() -> str:
    pair_body = _EXPLAIN_PAIR[_EXPLAIN_PAIR.index("SELECT target_id AS source_id"):]
    ctes = _EXPLAIN_PAIR[len("WITH "):_EXPLAIN_PAIR.index(" SELECT target_id AS source_id")]
    x = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS feature, row_id, CAST(raw_{i} AS DOUBLE) AS v, f{i} AS f FROM fm"
        for i, c in enumerate(RECOMMENDER_FEATURES))
    return (f"WITH {ctes}, pr AS ({pair_body}), x AS ({x}) "
            "SELECT pr.source_id, pr.target_id, s.pos, s.feature, round(s.v, 6) AS source_value, "
            "round(t.v, 6) AS target_value, round(s.f * t.f, 6) AS contribution "
            "FROM pr JOIN x s ON s.row_id = pr.source_id JOIN x t ON t.row_id = pr.target_id AND t.pos = s.pos")


@register("rec_explain", _rec_explain_sql())
def q_rec_explain(spark, sf_dir):
    """Why the first item's most similar item was recommended (the pair comes from the data)."""
    rec = _recommender(spark, sf_dir)
    first = rec.matrix.agg(F.min("row_id").alias("target_id"))
    top1 = rec._rank(rec._targets_by_id(first), 1, True, False).select(
        F.col("target_id").alias("source_id"), F.col("row_id").alias("target_id"))
    e = rec.explain_pairs(top1)
    return e.select("source_id", "target_id", "pos", "feature", r("source_value"), r("target_value"),
                    r("contribution"))


# ================================================================ scale bindings on the large tables


@register("basic_stats_lineitem", "WITH x AS (SELECT 1) " + _basic_stats_sql(_LI_CORR, "lineitem"))
def q_basic_stats_lineitem(spark, sf_dir):
    return profile.basic_statistics(read_table(spark, sf_dir, "lineitem"), _LI_CORR, decimals=D)


@register("duplicates_lineitem", "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM lineitem "
          "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
          "l_returnflag, l_linestatus, l_shipdate)")
def q_duplicates_lineitem(spark, sf_dir):
    return quality.duplicate_rows(read_table(spark, sf_dir, "lineitem"))


@register("outliers_events", (
    "WITH b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, "
    "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events) "
    "SELECT count_if(value < lo OR value > hi) AS total_outliers, "
    "round(count_if(value < lo OR value > hi) / count(*) * 100, 6) AS outlier_percentage, "
    "round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound FROM events, b GROUP BY lo, hi"))
def q_outliers_events(spark, sf_dir):
    o = profile.outlier_stats(read_table(spark, sf_dir, "events"), "value", "iqr", 1.5)
    return o.select("total_outliers", r("outlier_percentage"), r("lower_bound"), r("upper_bound"))


@register("by_order_status", (
    "SELECT o_orderstatus, count(o_totalprice) AS car_count, round(avg(o_totalprice), 6) AS avg_price, "
    "round(quantile_cont(o_totalprice, 0.5), 6) AS median_price, round(min(o_totalprice), 6) AS min_price, "
    "round(max(o_totalprice), 6) AS max_price, round(avg(o_custkey), 6) AS avg_hp, "
    "round(max(o_custkey), 6) AS max_hp FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus"))
def q_by_order_status(spark, sf_dir):
    return profile.by_brand(read_table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_custkey",
                            decimals=D)


# ================================================================ PRF-11 report bundle and SRC-1/2


def _eda_sql() -> str:
    x = f"(SELECT {PRICE} AS x FROM specs WHERE {PRICE} IS NOT NULL)"
    sections = {
        "dataset_shape": (f"SELECT count(*) AS rows, {len(_SPECS_COLUMNS)} AS columns FROM specs", None, ["rows", "columns"]),
        "basic_statistics": (_basic_stats_sql(_STAT_COLS, "specs"), '"column"',
                             ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "missing", "missing_pct"]),
        "price_analysis": (
            "SELECT avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min, "
            "max(x) AS max, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, "
            "quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, skewness(x) AS skewness, kurtosis(x) AS kurtosis, "
            f"count(x) AS count FROM {x}", None,
            ["mean", "median", "std", "min", "max", "q25", "q75", "iqr", "skewness", "kurtosis", "count"]),
        "price_segments": (
            f"SELECT count_if({PRICE} < 30000) AS budget, count_if({PRICE} >= 30000 AND {PRICE} < 100000) AS mid_range, "
            f"count_if({PRICE} >= 100000 AND {PRICE} < 500000) AS premium, count_if({PRICE} >= 500000) AS luxury FROM specs",
            None, ["budget", "mid_range", "premium", "luxury"]),
        "correlation_matrix": (_corr_sql(_STAT_COLS, "specs"), "\"row\" || '|' || col", ["corr"]),
        "brand_analysis": (
            f"SELECT {MAKER}, count({PRICE}) AS car_count, avg({PRICE}) AS avg_price, "
            f"quantile_cont({PRICE}, 0.5) AS median_price, min({PRICE}) AS min_price, max({PRICE}) AS max_price, "
            f"avg({HP}) AS avg_hp, max({HP}) AS max_hp FROM specs WHERE {MAKER} IS NOT NULL GROUP BY {MAKER}", MAKER,
            ["car_count", "avg_price", "median_price", "min_price", "max_price", "avg_hp", "max_hp"]),
        "fuel_type_analysis": (
            f"SELECT {FUEL}, " + ", ".join(f"count({c}) AS {c}_count, avg({c}) AS {c}_mean" for c in (PRICE, HP, ACCEL))
            + f" FROM specs WHERE {FUEL} IS NOT NULL GROUP BY {FUEL}", FUEL,
            [f"{c}_{m}" for c in (PRICE, HP, ACCEL) for m in ("count", "mean")]),
        "performance_price": (
            f"SELECT category, avg({PRICE}) AS mean, quantile_cont({PRICE}, 0.5) AS median, count({PRICE}) AS count, "
            f"(SELECT corr({ACCEL}, {PRICE}) FROM pv) AS correlation FROM pv GROUP BY category", "category",
            ["mean", "median", "count", "correlation"]),
    }
    ctes = [f"pv AS (SELECT *, CASE WHEN {ACCEL} < 4.5 THEN 'High-Performance' WHEN {ACCEL} <= 8.0 THEN 'Mid-Range' "
            f"ELSE 'Economy' END AS category FROM specs WHERE {ACCEL} IS NOT NULL AND {PRICE} IS NOT NULL)"]
    rows = []
    for i, (sec, (body, item, metrics)) in enumerate(sections.items()):
        ctes.append(f"e{i} AS ({body})")
        it = f"CAST({item} AS VARCHAR)" if item else "''"
        rows += [f"SELECT '{sec}' AS section, {it} AS item, '{m}' AS metric, round(CAST(\"{m}\" AS DOUBLE), 6) AS value "
                 f"FROM e{i}" for m in metrics]
    return O.with_specs(" UNION ALL ".join(rows), ", ".join(ctes))


_SPECS_COLUMNS = ["row_id", *_RAW_NO_ID, *_TYPED_NUM, FUEL, MAKER, NAME, PERF_CATEGORY, IS_LUXURY, PRICE_PER_HP,
                  POWER_TO_SPEED, IS_ELECTRIC]


@register("eda_report", _eda_sql())
def q_eda_report(spark, sf_dir):
    return profile.eda_report_long(specs(spark, sf_dir), decimals=D)


def _csv_round_trip(spark, sf_dir):
    """The raw table written as spec-sheet CSV files (contract headers) into the shared checkpoint dir, read back
    by the CSV source (all-string schema, required-column check, encoding detection, split files)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.csv import RAW_NAMES, REQUIRED_COLUMNS, load_specs_csv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    raw = raw_specs(spark, sf_dir)
    raw.select(*[F.col(n).alias(h) for n, h in zip(RAW_NAMES, REQUIRED_COLUMNS)]) \
        .write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return load_specs_csv(spark, path)


@register("src_csv", O.with_specs(
    "SELECT count(*) AS rows, count(DISTINCT company_names) AS makers, count(cars_prices) AS priced, "
    "CAST(sum(length(coalesce(cars_names, ''))) AS BIGINT) AS name_chars FROM raw_specs"))
def q_src_csv(spark, sf_dir):
    """Round trip: four counts of the rows read back."""
    back = _csv_round_trip(spark, sf_dir)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("company_names").alias("makers"),
                    F.count("cars_prices").alias("priced"),
                    F.sum(F.length(F.coalesce("cars_names", F.lit("")))).cast("bigint").alias("name_chars"))


@register("src_csv_rows", O.with_specs(
    "SELECT company_names, cars_names, engines, cc_battery, horsepower, total_speed, accel_0_100, cars_prices, fuel_types, seats, torque "
    "FROM raw_specs"))
def q_src_csv_rows(spark, sf_dir):
    """Round trip: the rows themselves."""
    return _csv_round_trip(spark, sf_dir).drop("row_id")


def _validate_columns_sql() -> str:
    columns = [(c, "string") for c in _RAW_NO_ID] + [(c, "double") for c in _TYPED_NUM]
    return O.with_specs(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{d}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing, count(*) AS total_rows FROM specs"
        for c, d in columns))


@register("validate_columns", _validate_columns_sql())
def q_validate_columns(spark, sf_dir):
    """Type and number of nulls of every raw and typed column, in one aggregate."""
    return quality.missing_values(specs(spark, sf_dir), [*_RAW_NO_ID, *_TYPED_NUM])


# ================================================================ more bindings on the large tables


@register("priority_share", (
    "SELECT o_orderpriority, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS percentage "
    "FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"))
def q_priority_share(spark, sf_dir):
    return explore.category_share(read_table(spark, sf_dir, "orders"), "o_orderpriority", decimals=D)


@register("cheapest_per_priority", (
    "SELECT o_orderpriority, o_orderkey, round(o_totalprice, 6) AS o_totalprice, rank FROM (SELECT *, "
    "row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders "
    "WHERE o_totalprice IS NOT NULL) WHERE rank <= 5"))
def q_cheapest_per_priority(spark, sf_dir):
    out = explore.smallest_per_group(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 5,
                                     groups=None, columns=["o_totalprice"], order_col="o_orderkey")
    return out.select("o_orderpriority", "o_orderkey", r("o_totalprice"), F.col("rank").cast("bigint").alias("rank"))


@register("top_customers", (
    "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, count(o_totalprice) AS count FROM orders "
    "WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(o_totalprice) >= 10 "
    "ORDER BY avg(o_totalprice) DESC, o_custkey LIMIT 10"))
def q_top_customers(spark, sf_dir):
    t = explore.top_groups_by_mean(read_table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 10, 10)
    return t.select("o_custkey", r("mean"), "count")


@register("events_categorical", (
    "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS count, "
    "round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage FROM events WHERE event_type IS NOT NULL "
    "GROUP BY event_type"))
def q_events_categorical(spark, sf_dir):
    return profile.categorical_summary(read_table(spark, sf_dir, "events"), ["event_type"])


@register("returnflag_share", (
    "SELECT l_returnflag, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage "
    "FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"))
def q_returnflag_share(spark, sf_dir):
    return charts.value_share(read_table(spark, sf_dir, "lineitem"), "l_returnflag", decimals=D)


@register("scale_events", (
    "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN (value - c) / coalesce(nullif(s, 0), 1) END, 6) "
    "AS value_Scaled FROM events, (SELECT avg(value) AS c, stddev_pop(value) AS s FROM events WHERE value IS NOT NULL)"))
def q_scale_events(spark, sf_dir):
    out = features.scale_numerical_features(read_table(spark, sf_dir, "events"), ["value"], "standard")
    return out.select("event_id", r("value_Scaled"))


# Model, attribution and pipeline queries register themselves on import.
from . import ml_queries  # noqa: E402,F401


# ================================================================ rows with hits on the large tables


@register("outlier_rows_events", (
    "WITH b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, "
    "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events) "
    "SELECT event_id, round(value, 6) AS value FROM events, b WHERE value < lo OR value > hi"))
def q_outlier_rows_events(spark, sf_dir):
    return profile.identify_outliers(read_table(spark, sf_dir, "events"), "value", "iqr", 1.5).select("event_id", r("value"))


@register("zscore_rows_events", (
    "WITH z AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) "
    "SELECT event_id, round(value, 6) AS value FROM events, z WHERE abs((value - m) / nullif(s, 0)) > 3"))
def q_zscore_rows_events(spark, sf_dir):
    return profile.identify_outliers(read_table(spark, sf_dir, "events"), "value", "zscore", 3.0).select("event_id", r("value"))


@register("duplicates_lineitem_keys", "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM "
          "(SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def q_duplicates_lineitem_keys(spark, sf_dir):
    return quality.duplicate_rows(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("issues_lineitem_keys", (
    "SELECT CAST(NULL AS VARCHAR) AS \"column\", CAST(0 AS BIGINT) AS missing, "
    "'Found ' || CAST(sum(c - 1) AS BIGINT) || ' duplicate rows' AS issue FROM "
    "(SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) HAVING sum(c - 1) > 0"))
def q_issues_lineitem_keys(spark, sf_dir):
    return quality.validate_issues(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("reg_folds", (
    "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), "
    "f AS (SELECT o_orderkey, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) "
    "ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM p) "
    "SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM f GROUP BY fold"))
def q_reg_folds(spark, sf_dir):
    folds = metrics.contiguous_folds(read_table(spark, sf_dir, "orders"), 5, "o_orderkey")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"),
                                     F.max("o_orderkey").alias("last_id"))


@register("label_codes_customers", (
    "SELECT c_name AS value, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS code FROM "
    "(SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL)"))
def q_label_codes_customers(spark, sf_dir):
    return features.label_mapping(read_table(spark, sf_dir, "customer"), "c_name")

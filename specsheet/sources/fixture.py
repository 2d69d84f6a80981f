"""``raw_specs``: a deterministic raw spec-sheet table derived from ``part``.

The raw layer holds free text exactly as a scraped spec sheet would (prices with ``$`` and
ranges, ``"300-315 hp"``, ``"n/a"`` speeds, ``"2+2"`` seats ...). Rows grow with ``part``, so
every query over it scales with the scale factor. The expressions are written once as SQL
text; Spark evaluates them through ``selectExpr`` and the DuckDB oracle embeds the same text,
so both engines start from identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table, spread

# Stage 1: per-row keys the text columns are generated from.
STAGE1 = [
    "p_partkey AS k",
    "(p_partkey * 7919) % 900000 + 500 AS lo",
    "p_size * 15 + 60 AS hp",
    "20 + (p_partkey * 53) % 120 AS a",
]

# Stage 2: formatted number pieces.
STAGE2 = [
    "concat(CAST(CAST(floor(lo / 1000.0) AS BIGINT) AS STRING), ',', "
    "lpad(CAST(lo % 1000 AS STRING), 3, '0')) AS lo_s",
    "concat(CAST(CAST(floor((lo + 3000) / 1000.0) AS BIGINT) AS STRING), ',', "
    "lpad(CAST((lo + 3000) % 1000 AS STRING), 3, '0')) AS hi_s",
    "CAST(CAST(floor(a / 10.0) AS BIGINT) AS STRING) AS a1",
    "CAST(a % 10 AS STRING) AS a0",
]

# Stage 3: the raw columns (snake-case names of the 11 contract columns) plus row_id.
STAGE3 = [
    "p_partkey AS row_id",
    "CASE p_brand WHEN 'Brand#1' THEN ' Ferrari' WHEN 'Brand#2' THEN 'ferrari ' "
    "WHEN 'Brand#3' THEN 'BMW' WHEN 'Brand#4' THEN 'Rolls-Royce' WHEN 'Brand#5' THEN 'Toyota ' "
    "ELSE p_brand END AS company_names",
    "concat(' ', p_name, ' ', CAST(p_partkey AS STRING), ' ') AS cars_names",
    "p_type AS engines",
    "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 8 = 0 THEN concat(CAST(k % 90 + 30 AS STRING), ' kWh') "
    "ELSE concat(CAST(k % 5 + 1 AS STRING), ',', lpad(CAST(k % 1000 AS STRING), 3, '0'), ' cc') END "
    "AS cc_battery",
    "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 5 = 0 THEN concat(CAST(hp AS STRING), '-', "
    "CAST(hp + 15 AS STRING), ' hp') ELSE concat(CAST(hp AS STRING), ' hp') END AS horsepower",
    "CASE WHEN k % 29 = 0 THEN 'n/a' ELSE concat(CAST(140 + (k * 37) % 210 AS STRING), ' km/h') END "
    "AS total_speed",
    "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 9 = 0 THEN concat(a1, '.', a0, ' - ', "
    "CAST(CAST(a1 AS BIGINT) + 1 AS STRING), '.', a0, ' sec') ELSE concat(a1, '.', a0, ' sec') END "
    "AS accel_0_100",
    "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN concat('$', lo_s, ' - $', hi_s) "
    "WHEN k % 13 = 0 THEN concat('? ', lo_s) WHEN k % 17 = 0 THEN 'TBD' "
    "ELSE concat('$', lo_s, ' ') END AS cars_prices",
    "CASE k % 10 WHEN 0 THEN 'Petrol' WHEN 1 THEN 'Diesel' WHEN 2 THEN 'Electric' "
    "WHEN 3 THEN 'Petrol/Hybrid' WHEN 4 THEN 'plug in hyrbrid' WHEN 5 THEN 'CNG/Petrol' "
    "WHEN 6 THEN 'Hydrogen' WHEN 7 THEN 'CNG' WHEN 8 THEN NULL ELSE 'Diesel/Petrol' END AS fuel_types",
    "CASE WHEN k % 27 = 0 THEN '2+2' WHEN k % 33 = 0 THEN NULL ELSE CAST(2 + k % 6 AS STRING) END "
    "AS seats",
    "CASE WHEN k % 6 = 0 THEN concat(CAST(hp + 40 AS STRING), ' - ', CAST(hp + 90 AS STRING), ' Nm') "
    "ELSE concat(CAST(hp + 60 AS STRING), ' Nm') END AS torque",
]

RAW_COLUMNS = [
    "row_id", "company_names", "cars_names", "engines", "cc_battery", "horsepower",
    "total_speed", "accel_0_100", "cars_prices", "fuel_types", "seats", "torque",
]


def raw_specs_sql(part_table: str = "part") -> str:
    """The fixture as one SQL text (used by the DuckDB oracle)."""
    return (
        f"SELECT {', '.join(STAGE3)} FROM (SELECT *, {', '.join(STAGE2)} FROM "
        f"(SELECT *, {', '.join(STAGE1)} FROM {part_table}) t) u"
    )


def raw_specs_from_part(part: DataFrame) -> DataFrame:
    return part.selectExpr("*", *STAGE1).selectExpr("*", *STAGE2).selectExpr(*STAGE3)


def raw_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing starts from rows spread over tasks, whatever the row groups of ``part``."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    return raw_specs_from_part(spread(part))

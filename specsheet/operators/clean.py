"""Cleaning (text -> typed columns) and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import text
from ..functions.stats import attach, quantiles

# Names of the typed columns the cleaner adds.
PRICE = "Price_USD"
HP = "HorsePower_Numeric"
SPEED = "Speed_KMH"
ACCEL = "Acceleration_Sec"
TORQUE = "Torque_Nm"
CC = "CC_Numeric"
SEATS = "Seats_Numeric"
FUEL = "Fuel_Type_Std"
MAKER = "Company_Clean"
NAME = "Car_Name_Clean"

NUMERIC_COLUMNS = [PRICE, HP, SPEED, ACCEL, TORQUE, CC, SEATS]


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)


def clean_dataset(
    df: DataFrame,
    price: str = "cars_prices",
    horsepower: str = "horsepower",
    speed: str = "total_speed",
    acceleration: str = "accel_0_100",
    torque: str = "torque",
    cc: str = "cc_battery",
    seats: str = "seats",
    fuel: str = "fuel_types",
    maker: str = "company_names",
    name: str = "cars_names",
) -> DataFrame:
    """Add the ten typed columns next to the raw ones, in a single projection.

    A raw column that is already numeric is taken as a number (power and torque: null, as a
    non-text spec cannot be a range of the expected form).
    """

    st = text.Stager("__cln")

    def num_or(c: str, parser, numeric_value=None):
        if _numeric(df, c):
            return numeric_value if numeric_value is not None else F.col(c).cast("double")
        return parser(c, st) if parser is not text.extract_numeric else parser(c)

    null = F.lit(None).cast("double")
    return st.apply(df, {
        PRICE: null if _numeric(df, price) else text.parse_price(price, st),
        HP: num_or(horsepower, text.parse_horsepower, null),
        SPEED: num_or(speed, text.extract_numeric),
        ACCEL: null if _numeric(df, acceleration) else text.parse_acceleration(acceleration, st),
        TORQUE: num_or(torque, text.parse_torque, null),
        CC: num_or(cc, text.extract_numeric),
        SEATS: num_or(seats, text.parse_seats, F.col(seats).cast("double").try_cast("bigint").cast("double")),
        FUEL: F.lit("Other") if _numeric(df, fuel) else text.fuel_class(fuel),
        MAKER: text.normalize_maker(maker),
        NAME: text.normalize_name(name),
    })


def remove_invalid_rows(
    df: DataFrame, price_col: str = PRICE, min_price: float = 1000, max_price: float = 50_000_000
) -> DataFrame:
    """Keep rows whose price is present and within ``[min_price, max_price]``.

    Row identity stays in ``row_id``; nothing is renumbered (positions are never needed).
    """
    # The price is referenced once (bound by a lambda): Catalyst pushes this predicate below
    # the cleaning projection by inlining the price expression, and ``between`` would inline it
    # twice.
    in_range = F.exists(F.array(F.col(price_col)), lambda p: p.between(min_price, max_price))
    return df.where(in_range)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def trim_quantile(df: DataFrame, column: str, q: float = 0.99, exact: bool = True) -> DataFrame:
    """Rows whose ``column`` is at most its ``q`` quantile (nulls dropped)."""
    bound = quantiles(df, column, [q], exact=exact, prefix="__trim").select("__trim0")
    return attach(df, bound, []).where(F.col(column) <= F.col("__trim0")).drop("__trim0")

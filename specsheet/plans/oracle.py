"""DuckDB SQL twins of the registered queries.

The driver only registers the base tables, so every text inlines the fixture and the cleaning
macros as CTEs. The macros are generated here as SQL expression text.
"""

from __future__ import annotations

from ..sources.fixture import raw_specs_sql


def num(x: str) -> str:
    return (
        "try_cast(nullif(regexp_extract(replace(regexp_replace(trim({x}),"
        "'\\s*(hp|km/h|nm|cc|sec|kwh)\\s*','','gi'),',',''),'[-+]?\\d*\\.?\\d+'),'') as double)"
    ).format(x=x)


def _isr(x: str) -> str:
    return f"(contains({x},' - ') or contains({x},' to '))"


def _part(x: str, i: int) -> str:
    return num(f"regexp_split_to_array({x},'\\s*[-–]\\s*|\\s+to\\s+')[{i}]")


def price(x: str) -> str:
    t = f"translate(trim({x}),'$?€','')"
    lo, hi = _part(t, 1), _part(t, 2)
    return f"(case when {_isr(t)} then coalesce(({lo}+{hi})/2, {lo}, {hi}, {num(t)}) else {num(t)} end)"


def accel(x: str) -> str:
    t = f"regexp_replace(lower(trim({x})),'\\s*sec(onds?)?\\s*','','g')"
    lo, hi = _part(t, 1), _part(t, 2)
    return f"(case when {_isr(t)} then coalesce(({lo}+{hi})/2, {num(t)}) else {num(t)} end)"


def _multi(v: str, n: int) -> str:
    vals = (
        f"list_transform(list_filter(string_split({v},'-'), lambda y: trim(y)<>''), "
        f"lambda y: try_cast(replace(trim(y),',','') as double))"
    )
    return (
        f"(case when contains({v},'-') and len({vals})>={n} and "
        f"len(list_filter({vals}, lambda y: y is null))=0 "
        f"then list_avg({vals}) else {num(v)} end)"
    )


def hp(x: str) -> str:
    return _multi(f"trim(replace(lower({x}),'hp',''))", 0)


def torque(x: str) -> str:
    return _multi(f"trim(replace(lower({x}),'nm',''))", 2)


def seats(x: str) -> str:
    return f"cast(trunc(try_cast({x} as double)) as double)"


def fuel(x: str) -> str:
    s = f"lower({x})"
    return (
        f"(case when {x} is null then 'Other' "
        f"when contains({s},'electric') and not contains({s},'hybrid') then 'Electric' "
        f"when contains({s},'plug') then 'Plug-in Hybrid' "
        f"when contains({s},'hybrid') or contains({s},'hyrbrid') then 'Hybrid' "
        f"when contains({s},'diesel') and not contains({s},'petrol') then 'Diesel' "
        f"when contains({s},'petrol') or contains({s},'gas') then 'Petrol' "
        f"when contains({s},'cng') then 'CNG' when contains({s},'hydrogen') then 'Hydrogen' "
        f"else 'Other' end)"
    )


# The luxury maker set (lower-case, as matched).
from ..operators.features import LUXURY_BRANDS  # noqa: E402


def cleaned_select() -> str:
    return (
        "SELECT *, "
        f"{price('cars_prices')} AS Price_USD, "
        f"{hp('horsepower')} AS HorsePower_Numeric, "
        f"{num('total_speed')} AS Speed_KMH, "
        f"{accel('accel_0_100')} AS Acceleration_Sec, "
        f"{torque('torque')} AS Torque_Nm, "
        f"{num('cc_battery')} AS CC_Numeric, "
        f"{seats('seats')} AS Seats_Numeric, "
        f"{fuel('fuel_types')} AS Fuel_Type_Std, "
        "upper(trim(company_names)) AS Company_Clean, "
        "trim(cars_names) AS Car_Name_Clean "
        "FROM raw_specs"
    )


def features_select(src: str = "valid") -> str:
    lux = ", ".join(f"'{b}'" for b in LUXURY_BRANDS)
    return (
        "SELECT *, "
        "CASE WHEN Acceleration_Sec IS NULL THEN 'Unknown' WHEN Acceleration_Sec < 4.5 THEN 'High-Performance' "
        "WHEN Acceleration_Sec <= 8.0 THEN 'Mid-Range' ELSE 'Economy' END AS Performance_Category, "
        f"coalesce(lower(trim(Company_Clean)) IN ({lux}), false) AS Is_Luxury_Brand, "
        "Price_USD / nullif(HorsePower_Numeric, 0) AS Price_Per_HP, "
        "HorsePower_Numeric / nullif(Speed_KMH, 0) AS Power_To_Speed_Ratio, "
        "coalesce(Fuel_Type_Std IN ('Electric', 'Hybrid', 'Plug-in Hybrid'), false) AS Is_Electric "
        f"FROM {src}"
    )


def specs_ctes() -> str:
    """raw_specs -> cleaned -> valid -> specs (features added)."""
    return (
        f"raw_specs AS ({raw_specs_sql()}), "
        f"cleaned AS ({cleaned_select()}), "
        "valid AS (SELECT * FROM cleaned WHERE Price_USD BETWEEN 1000 AND 50000000), "
        f"specs AS ({features_select()})"
    )


def with_specs(body: str, extra_ctes: str = "") -> str:
    extra = f", {extra_ctes}" if extra_ctes else ""
    return f"WITH {specs_ctes()}{extra} {body}"

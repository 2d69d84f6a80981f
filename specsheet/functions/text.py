"""Free text -> typed value parsers, as Spark ``Column`` expressions.

All parsers are compositions of built-in expressions (regexp, split, higher-order array
functions, try_cast), so they stay inside whole-stage codegen; no Python UDF is involved.
Java regexes need ``(?U)`` to make ``\\s`` and ``\\d`` Unicode-aware like Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that define the parsing semantics.
UNIT_PATTERN = r"(?iU)\s*(hp|km/h|nm|cc|sec|kwh)\s*"
NUMBER_PATTERN = r"(?U)[-+]?\d*\.?\d+"
RANGE_SPLIT_PATTERN = r"(?U)\s*[-–]\s*|\s+to\s+"
SECONDS_PATTERN = r"(?U)\s*sec(onds?)?\s*"
STRIP_PATTERN = r"(?U)^\s+|\s+$"
# What a plain decimal literal looks like (guards try_cast against Java-only spellings
# such as "5d" or "Infinity").
FLOAT_LITERAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PRICE_SYMBOLS = "$?€"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def extract_numeric(c: ColumnOrName) -> Column:
    """First number in a text after dropping unit words and thousands separators.

    ``"3,990 cc"`` -> 3990, ``"2 cc 500"`` -> 2500 (the unit and its spaces are removed),
    ``"abc"`` -> null. Expects a string column (numeric columns: ``cast("double")``).
    """
    col = _c(c)
    s = F.regexp_replace(strip(col), UNIT_PATTERN, "")
    s = F.replace(s, F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(s, NUMBER_PATTERN, 0), F.lit("")).try_cast("double")


def _inline(expr: Column, level: int) -> Column:
    return expr


class Stager:
    """Binds intermediate expressions to temporary columns, one projection per level.

    A parser written against ``bind(expr, level)`` inlines everything when ``bind`` is
    ``_inline`` (column-level use), or computes each piece once when bound through a
    ``Stager`` (table-level use). Without staging a value such as the stripped price text is
    re-evaluated in every branch that mentions it, and the generated code can outgrow the JVM
    method limit, which silently drops whole-stage codegen.
    """

    def __init__(self, prefix: str = "__s"):
        self.prefix = prefix
        self.levels: dict[int, dict[str, Column]] = {}
        self.count = 0

    def __call__(self, expr: Column, level: int) -> Column:
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.levels.setdefault(level, {})[name] = expr
        return F.col(name)

    def apply(self, df, final: dict[str, Column]):
        for level in sorted(self.levels):
            df = df.withColumns(self.levels[level])
        temps = [n for lv in self.levels.values() for n in lv]
        return df.withColumns(final).drop(*temps)


def _is_range(s: Column) -> Column:
    return s.contains(" - ") | s.contains(" to ")


def _range_parts(t: Column, bind, level: int) -> tuple[Column, Column, Column]:
    parts = bind(F.split(t, RANGE_SPLIT_PATTERN, -1), level)
    lo = bind(extract_numeric(F.get(parts, 0)), level + 1)
    hi = bind(extract_numeric(F.get(parts, 1)), level + 1)
    whole = bind(extract_numeric(t), level)
    return lo, hi, whole


def parse_price(c: ColumnOrName, bind=_inline) -> Column:
    """Price text -> number. A range (``" - "`` or ``" to "``) gives its midpoint, or the one
    side that parses; otherwise the first number."""
    t = bind(F.translate(strip(_c(c)), PRICE_SYMBOLS, ""), 1)
    lo, hi, whole = _range_parts(t, bind, 2)
    return F.when(_is_range(t), F.coalesce((lo + hi) / 2, lo, hi, whole)).otherwise(whole)


def parse_acceleration(c: ColumnOrName, bind=_inline) -> Column:
    """0-100 time text -> seconds. A range needs both sides numeric to give the midpoint."""
    t = bind(F.regexp_replace(F.lower(strip(_c(c))), SECONDS_PATTERN, ""), 1)
    lo, hi, whole = _range_parts(t, bind, 2)
    return F.when(_is_range(t), F.coalesce((lo + hi) / 2, whole)).otherwise(whole)


def _float_or_null(s: Column) -> Column:
    """Python ``float()`` of a stripped text for plain decimal literals; null otherwise."""
    return F.when(s.rlike(FLOAT_LITERAL), s.try_cast("double"))


def _dash_mean(c: ColumnOrName, unit: str, min_parts: int, bind) -> Column:
    v = bind(strip(F.replace(F.lower(_c(c)), F.lit(unit), F.lit(""))), 1)
    parts = F.filter(F.split(v, "-", -1), lambda p: strip(p) != "")
    vals = bind(F.transform(parts, lambda p: _float_or_null(F.replace(strip(p), F.lit(","), F.lit("")))), 2)
    n = F.size(vals)
    all_parse = ~F.exists(vals, lambda x: x.isNull())
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(n, F.lit(0))
    use_mean = v.contains("-") & all_parse & (n >= min_parts)
    return F.when(use_mean, mean).otherwise(bind(extract_numeric(v), 2))


def parse_horsepower(c: ColumnOrName, bind=_inline) -> Column:
    """Power text -> number; ``"70-85 hp"`` -> mean of all dash-separated parts (a bare ``"-"``
    gives null), anything that does not parse part-wise -> first number."""
    return _dash_mean(c, "hp", 0, bind)


def parse_torque(c: ColumnOrName, bind=_inline) -> Column:
    """Torque text -> number; as horsepower but a range needs at least two parts, so
    ``"-200 Nm"`` stays -200."""
    return _dash_mean(c, "nm", 2, bind)


def parse_seats(c: ColumnOrName, bind=_inline) -> Column:
    """``int(float(text))`` as double: truncation toward zero, unparseable -> null."""
    d = _float_or_null(bind(strip(_c(c)), 1))
    return d.try_cast("bigint").cast("double")


# Fuel classes, in the order the rules are tried.
FUEL_CLASSES = ["Electric", "Plug-in Hybrid", "Hybrid", "Diesel", "Petrol", "CNG", "Hydrogen", "Other"]


def fuel_class(c: ColumnOrName) -> Column:
    """Free-text fuel -> one of ``FUEL_CLASSES``; first matching rule wins, null -> Other."""
    s = F.lower(_c(c))
    has = s.contains
    return (
        F.when(s.isNull(), "Other")
        .when(has("electric") & ~has("hybrid"), "Electric")
        .when(has("plug"), "Plug-in Hybrid")
        .when(has("hybrid") | has("hyrbrid"), "Hybrid")
        .when(has("diesel") & ~has("petrol"), "Diesel")
        .when(has("petrol") | has("gas"), "Petrol")
        .when(has("cng"), "CNG")
        .when(has("hydrogen"), "Hydrogen")
        .otherwise("Other")
    )


def normalize_maker(c: ColumnOrName) -> Column:
    return F.upper(strip(c))


def normalize_name(c: ColumnOrName) -> Column:
    return strip(c)

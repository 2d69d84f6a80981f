"""Aggregate helpers: exact quantiles without a per-group value map, sample moments.

``percentile``/``median`` keep a value->count map per group in one task; for a group holding
a third of a 100 TB table that map does not fit. ``quantiles`` is a radix select instead, on the 64
bits of a double in the order of its values, for all groups and all ranks at once:

1. one hash aggregate counts the rows of each group by the top 22 bits (sign, exponent and ten bits of
   the mantissa); running counts say which of these cells holds each target rank, and the rank in it;
2. rows of those cells are counted by the next 21 bits, all others are passed over;
3. the same by the last 21 bits, where a cell is one value: the one at the target rank.

A group has at most 2^22, 2^21 and 2^21 cells per rank in the three passes, whatever the
distribution of its values and however many rows it has, and counts are combined before each
shuffle. Ranks are interpolated linearly like ``quantile_cont`` / pandas: ``x[lo] + (pos - lo) * (x[hi] -
x[lo])``, ``pos = p (n - 1)``.

``exact=False`` returns the values of a bounded-memory sketch directly (one pass).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_ACCURACY = 10000


def _by_list(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group statistics back to the rows.

    Without grouping keys the statistics are one row, a proven size bound, so they are
    broadcast. Per-group statistics have one row per group: the join is left to the planner,
    whose size check (and AQE's runtime one) broadcasts them when small and otherwise falls
    back to a shuffle join.
    """
    if not by:
        return df.crossJoin(F.broadcast(stats))
    return df.join(stats, on=list(by), how="inner")


LOW_BITS, MID_BITS = 21, 21


def with_ordered_bits(df: DataFrame, v: str, out: str) -> DataFrame:
    """Adds the bits of the double ``v`` as a long that orders like the value: exponent and mantissa of its
    magnitude, negated for negative values. Both zeros are 0; NaN comes after all others. In steps, so
    that the logarithm and the powers are taken once a value."""
    a, guess, power, e = (F.col(f"__bits_{c}") for c in "agpe")
    two = F.lit(2.0)
    normal = (a > 0) & (a < float("inf"))  # not NaN, zero or infinite
    steps = df.withColumn("__bits_a", F.abs(F.col(v))) \
        .withColumn("__bits_g", F.when(normal, F.least(F.floor(F.log2(a)), F.lit(1023))).otherwise(F.lit(0)).cast("int")) \
        .withColumn("__bits_p", F.pow(two, guess)) \
        .withColumn("__bits_e", guess + F.when(power > a, -1).when(power * 2 <= a, 1).otherwise(0))  # the logarithm may be off by one
    base = F.when(e == guess, power).when(e < guess, power / 2).otherwise(power * 2)  # exact, as is the division by it
    bits = (F.when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("long"))
            .when(a == float("inf"), F.lit(2047 << 52).cast("long"))
            .otherwise((e + 1023).cast("long") * (1 << 52) + ((a / base - 1.0) * float(1 << 52)).cast("long")))
    signed = F.when(F.isnan(F.col(v)), F.lit((1 << 63) - 1).cast("long")).when(F.col(v) < 0, -bits).otherwise(bits)
    return steps.withColumn(out, F.when(F.col(v).isNotNull(), signed)).drop(*[f"__bits_{c}" for c in "agpe"])


def quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: str | Sequence[str] | None = None,
    exact: bool = True,
    accuracy: int = DEFAULT_ACCURACY,
    prefix: str = "q",
    bounds: bool = False,
    aggs: Sequence[Column] = (),
    refine: bool = True,
    few_groups: bool = False,
) -> DataFrame:
    """Per-group quantiles of ``value`` (nulls ignored; null keys dropped like pandas).

    Returns ``by... , n, <prefix>0, <prefix>1, ...`` with one column per probability.
    ``bounds=True`` adds ``min``, ``max`` and ``<prefix>le<j>`` = the largest value that is at most
    quantile ``j`` (one of its two interpolation points, so no extra pass is needed).
    ``aggs``: further aggregate expressions over all rows of each group (null values included),
    computed in the first pass and returned as extra columns.
    Groups with no non-null value are absent unless ``aggs`` are given (then their quantiles are
    null). ``accuracy`` is that of ``exact=False``; ``refine`` has no effect any more. ``few_groups``: the
    caller knows that the groups are few (one per column, say), so their ranks are broadcast.
    """
    keys = _by_list(by)
    probs = [float(p) for p in probs]
    k = len(probs)
    aggs = list(aggs)
    v = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("__v", v.cast("double"))
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    # With carried aggregates every row takes part (null values included); otherwise only the
    # non-null values are read.
    first = rows if aggs else rows.select(*keys, "__v").where(F.col("__v").isNotNull())
    carried = [c for c in first.groupBy(*keys).agg(*aggs).columns if c not in keys] if aggs else []
    if not exact:
        out = first.groupBy(*keys).agg(
            *aggs,
            F.count("__v").alias("n"),
            F.percentile_approx("__v", probs, accuracy).alias("__q"),
            F.min("__v").alias("min"), F.max("__v").alias("max"),
        )
        extra = ["min", "max", *[F.col("__q")[j].alias(f"{prefix}le{j}") for j in range(k)]] if bounds else []
        return out.select(*keys, "n", *[F.col("__q")[j].alias(f"{prefix}{j}") for j in range(k)], *extra, *carried)

    pos = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ranks = [F.floor(x) for x in pos] + [F.ceil(x) for x in pos]
    # n, min, max, carried aggregates and the ranks' cells ride along as ``first()`` buffers (not hashed), so
    # each pass hands everything to the next and nothing is joined back.
    consts = ["n", "__min", "__max"]
    found = _top_cells(first, keys, ranks, aggs, carried)
    keyed = with_ordered_bits(first.select(*keys, "__v"), "__v", "__k")
    for bits in (("__mid", LOW_BITS, MID_BITS), ("__low", 0, LOW_BITS)):
        # Every row has its group: a left join, so that only the groups' side can be broadcast.
        joined = keyed.join(F.broadcast(found) if few_groups else found, keys, "left") if keys else attach(keyed, found, keys)
        found = _next_cells(joined, keys, consts, carried, 2 * k, *bits)
    lo = [F.col(f"__v{j}") for j in range(k)]
    hi = [F.col(f"__v{k + j}") for j in range(k)]
    qs, les = [], []
    for j in range(k):
        q = lo[j] + (pos[j] - F.floor(pos[j])) * (hi[j] - lo[j])
        q = F.when(lo[j] == hi[j], lo[j]).otherwise(q)  # equal infinities have no difference
        qs.append(q.alias(f"{prefix}{j}"))
        les.append(F.when(q >= hi[j], hi[j]).otherwise(lo[j]).alias(f"{prefix}le{j}"))
    extra = [F.col("__min").alias("min"), F.col("__max").alias("max"), *les] if bounds else []
    return found.select(*keys, "n", *qs, *extra, *carried)


def _holding(ranks: Sequence[Column], same: Sequence[Column], cell: dict[str, Column]) -> list[Column]:
    """For each rank the columns ``cell`` of the row whose places (``start`` to ``end``) it falls in, and the
    rank among that row's values: ``<name><i>`` and ``__r<i>``. Numbers only, so that aggregates hash."""
    out = []
    for i, (r, s) in enumerate(zip(ranks, same)):
        hit = s & (F.col("start") <= r) & (r < F.col("end"))
        out += [F.max(F.when(hit, c)).alias(f"{name}{i}") for name, c in {**cell, "__r": r - F.col("start")}.items()]
    return out


def _top_cells(first: DataFrame, keys: list[str], ranks: Sequence[Column], aggs: list[Column], carried: list[str]) -> DataFrame:
    """Per group ``n``, ``__min``, ``__max``, the carried aggregates and, for each rank, the top bits of its
    value (``__t<i>``) and its rank among the values that have them (``__r<i>``). One scan: a group's totals
    and its cells are two grouping sets of one aggregate."""
    top = F.shiftright("__k", LOW_BITS + MID_BITS)
    cells = with_ordered_bits(first, "__v", "__k").withColumn("__top", top).groupingSets([[F.col(c) for c in keys], [*[F.col(c) for c in keys], F.col("__top")]],
                                                        *keys, "__top").agg(
        *aggs, F.count("__v").alias("__c"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"), F.grouping("__top").alias("__all"))
    whole = F.col("__all") == 1
    # A group's totals come first, so every cell behind them sees its group's n.
    w = Window.partitionBy(*keys).orderBy(F.desc("__all"), "__top").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.where(whole | F.col("__top").isNotNull()) \
        .withColumn("n", F.first("__c").over(w)) \
        .withColumn("end", F.sum(F.when(whole, 0).otherwise(F.col("__c"))).over(w)) \
        .withColumn("start", F.when(whole, F.col("end")).otherwise(F.col("end") - F.col("__c")))
    total = lambda c: F.first(F.when(whole, F.col(c)), ignorenulls=True)
    out = cells.groupBy(*keys).agg(
        F.first("n").alias("n"), total("__mn").alias("__min"), total("__mx").alias("__max"),
        *_holding(ranks, [~whole] * len(ranks), {"__t": F.col("__top")}), *[total(c).alias(c) for c in carried])
    return out if aggs else out.where(F.col("n") > 0)


def _next_cells(rows: DataFrame, keys: list[str], consts: list[str], carried: list[str], k: int, name: str, shift: int, bits: int) -> DataFrame:
    """The same a level of bits further down, for the rows in the cells ``__t<i>``; all others go (those of groups
    without values collapse to one row). At the last level a cell is one value (``__v<i>``)."""
    above = F.shiftright("__k", shift + bits)
    inside = F.coalesce(reduce(lambda x, y: x | y, [above == F.col(f"__t{i}") for i in range(k)]), F.lit(False))
    digit = F.shiftright("__k", shift).bitwiseAND((1 << bits) - 1)
    wanted = [f"{c}{i}" for i in range(k) for c in ("__t", "__r")]
    cells = rows.where(inside | (F.col("n") == 0)).select(*keys, *consts, *carried, *wanted, "__v", F.when(inside, above).alias("__top"), F.when(inside, digit).alias(name)) \
        .groupBy(*keys, "__top", name).agg(
            F.count("__v").alias("__c"), F.min("__v").alias("__value"), *[F.first(c).alias(c) for c in [*consts, *wanted, *carried]])
    w = Window.partitionBy(*keys, "__top").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("end", F.sum("__c").over(w)).withColumn("start", F.col("end") - F.col("__c"))
    ranks = [F.col(f"__r{i}") for i in range(k)]
    same = [F.col("__top") == F.col(f"__t{i}") for i in range(k)]
    found = _holding(ranks, same, {"__t": F.col("__top") * (1 << bits) + F.col(name), "__v": F.col("__value")})
    return cells.groupBy(*keys).agg(*found, *[F.first(c).alias(c) for c in [*consts, *carried]])


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1 (pandas ``skew``); n < 3 -> null, zero variance -> 0."""
    col = F.col(c) if isinstance(c, str) else c
    n = F.count(col)
    g1 = F.skewness(col)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.var_pop(col) == 0, F.lit(0.0)).otherwise(
        F.sqrt(n * (n - 1)) / (n - 2) * g1
    )


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurtosis``); n < 4 -> null, zero variance -> 0."""
    col = F.col(c) if isinstance(c, str) else c
    n = F.count(col)
    g2 = F.kurtosis(col)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.var_pop(col) == 0, F.lit(0.0)).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    )


# ---------------------------------------------------------------- hash-order rank cuts
#
# Stratified splits and folds need, per class, "the first k rows of a pseudo-random order".
# A window per class would put a class holding a third of the table into one task. Instead the
# order is ``(h, id)`` with ``h = xxhash64(id, seed)`` (uniform over 64 bits), and the k-th row is
# found by a two-pass radix select: (1) counts per (class, top 20 bits of h) — map-side combined,
# at most 2^20 rows per class — locate the bucket holding rank k; (2) only the rows of that
# bucket (about n / 2^20 per class) are ranked exactly.

BUCKET_SHIFT = 44


def hash_order(df: DataFrame, id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def rank_cuts(df: DataFrame, by: Sequence[str], id_col: str, seed: int, fractions: Sequence[float]) -> DataFrame:
    """Per group, the ``(h, id)`` of the row at rank ``round(f * n)`` of the hash order, for each
    fraction ``f``; returns ``by..., cuts`` (array of structs ``j, h, id``, rank 0 -> null h)."""
    keys = list(by)
    base = df.select(*keys, hash_order(df, id_col, seed).alias("__h"), F.col(id_col).alias("__id"))
    base = base.withColumn("__b", F.shiftright("__h", BUCKET_SHIFT))
    counts = base.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wk = Window.partitionBy(*keys)
    cum = counts.withColumn("__end", F.sum("__c").over(wk.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("__n", F.sum("__c").over(wk))
    fr = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(f)).alias("f")) for j, f in enumerate(fractions)])
    targets = cum.select(*keys, "__b", "__c", "__end", "__n", F.inline(fr)) \
        .withColumn("__k", F.round(F.col("f") * F.col("__n")).cast("bigint")) \
        .where((F.col("__end") - F.col("__c") < F.col("__k")) & (F.col("__k") <= F.col("__end"))) \
        .select(*keys, "__b", "j", (F.col("__k") - (F.col("__end") - F.col("__c"))).alias("__r"))
    inside = base.join(targets, [*keys, "__b"], "inner")
    wr = Window.partitionBy(*keys, "j").orderBy("__h", "__id")
    picked = inside.withColumn("__rn", F.row_number().over(wr)).where(F.col("__rn") == F.col("__r"))
    cut_rows = picked.groupBy(*keys).agg(F.collect_list(F.struct(
        "j", F.col("__h").alias("h"), F.col("__id").alias("id"))).alias("cuts"))
    if not keys:
        return cut_rows
    groups = counts.select(*keys).distinct()
    return groups.join(cut_rows, keys, "left").select(
        *keys, F.coalesce("cuts", F.array().cast(cut_rows.schema["cuts"].dataType)).alias("cuts"))


def hash_chunks(df: DataFrame, by: str | Sequence[str] | None, id_col: str, seed: int,
                fractions: Sequence[float], out: str) -> DataFrame:
    """Adds ``out`` = index of the chunk of the per-group hash order a row falls into, where the
    chunk ends are at ranks ``round(f * n)`` (``fractions`` ascending). Rows with a null group
    key get null."""
    keys = _by_list(by)
    cuts = rank_cuts(df.where(F.lit(True) if not keys else F.col(keys[0]).isNotNull()), keys, id_col, seed, fractions)
    h = hash_order(df, id_col, seed)
    joined = attach(df.withColumn("__h", h), cuts, keys)
    after = F.size(F.filter("cuts", lambda c: (F.col("__h") > c["h"]) |
                            ((F.col("__h") == c["h"]) & (F.col(id_col) > c["id"]))))
    missing = len(fractions) - F.size("cuts")  # ranks 0: every row comes after them
    result = joined.withColumn(out, (after + missing).cast("int")).drop("__h", "cuts")
    if keys:
        nulls = df.where(F.col(keys[0]).isNull()).withColumn(out, F.lit(None).cast("int"))
        result = result.unionByName(nulls)
    return result


def _ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows sorted by range, with their partition (``__pid``) and place in it (``__i``), written
    once: what is counted per partition is then what is read."""
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    return materialize(ranged)


def with_dense_index(df: DataFrame, order: Sequence[str], out: str = "__pos") -> DataFrame:
    """Adds ``out`` = 0-based position in ``order`` (a total order is expected).

    Range-partitioned, sorted within partitions and written once (eager); a row's position is the
    row count of the partitions before it (a broadcast table with one row per partition) plus its
    place in its own. Never a window over rows without partition keys, never a trip through Python.
    """
    ranged = _ranked(df, order)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    return ranged.join(F.broadcast(offsets), "__pid").withColumn(out, F.col("__off") + F.col("__i")) \
        .drop("__pid", "__i", "__off")


def order_cuts(df: DataFrame, order_col: str, k: int) -> list:
    """The ``order_col`` values at which the 2nd to ``k``-th of ``k`` equal parts begin (the first
    ``n % k`` parts hold one row more). Eager: only the order column is sorted and written, one
    count per partition and ``k - 1`` values come to the driver."""
    keys = _ranked(df.select(F.col(order_col).alias("__v")), ["__v"])
    counts = {r["__pid"]: r["c"] for r in keys.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).collect()}
    n = sum(counts.values())
    wanted = [j * (n // k) + min(j, n % k) for j in range(1, k)]
    places, start = [], 0
    for pid in sorted(counts):
        places += [(pid, rank - start) for rank in wanted if start <= rank < start + counts[pid]]
        start += counts[pid]
    if not places:
        return []
    hit = reduce(lambda x, y: x | y, [(F.col("__pid") == p) & (F.col("__i") == i) for p, i in set(places)])
    found = {(r["__pid"], r["__i"]): r["__v"] for r in keys.where(hit).collect()}
    return [found[p] for p in places]

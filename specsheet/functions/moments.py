"""Pairwise-complete second moments of many columns at once, as matrix products.

With values ``X`` (0 where missing) and masks ``M`` (1 where present), ``M'M`` counts the rows in which both
columns of a pair are present, ``X'M`` sums one column over them, ``(X*X)'M`` its squares, and ``X'X`` the
products. Each task adds these products over its Arrow batches and returns one row per pair, so what is
shuffled depends on the number of columns alone, and generated code does not grow with the number
of pairs. Columns are centred by their means first, which keeps the sums free of cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = ("n", "si", "sj", "sii", "sjj", "sij", "nan")


def column_means(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Mean of each column over its finite values (0 if there are none)."""
    def finite(c):
        v = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    row = df.agg(*[F.avg(finite(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return np.array([v or 0.0 for v in row])


def pair_moments(df: DataFrame, columns: Sequence[str], centre: np.ndarray) -> DataFrame:
    """One row per unordered pair ``i <= j`` of positions in ``columns``: ``n`` rows with both, sums ``si``, ``sj``,
    ``sii``, ``sjj``, ``sij`` of the values less ``centre`` over them, and ``nan`` rows in which one is not finite."""
    d = len(columns)
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((len(_SUMS), d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in some.columns], axis=1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in some.columns], axis=1)
                odd = (present & ~np.isfinite(x)).astype(np.float64)
                m = present.astype(np.float64)
                x = np.where(present & (odd == 0), np.nan_to_num(x) - centre, 0.0)
                one, square = x.T @ m, (x * x).T @ m
                bad = odd.T @ m
                total += np.stack([m.T @ m, one, one.T, square, square.T, x.T @ x, bad + bad.T])
        cells = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *[pa.array(t[upper]) for t in total]]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", *_SUMS])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(columns)])
    parts = values.mapInArrow(products, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    # An input without partitions gives no rows: every pair has one of zeros.
    zeros = df.sparkSession.createDataFrame(pd.DataFrame({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), **{s: 0.0 for s in _SUMS}}))
    return parts.unionByName(zeros).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, corr`` for every pair ``i <= j``: Pearson on the rows that have both; null where a column is
    constant on them, a value is not finite, or there are fewer than two."""
    centre = column_means(df, columns)
    m = pair_moments(df, columns, centre)
    n = F.nullif(F.col("n"), F.lit(0.0))
    var_i = F.col("sii") - F.col("si") * F.col("si") / n
    var_j = F.col("sjj") - F.col("sj") * F.col("sj") / n
    covariance = F.col("sij") - F.col("si") * F.col("sj") / n
    # A constant column leaves nothing but rounding: of its centre, and of its centred sums.
    rounding = F.array(*[F.lit(float(max((abs(c) * 1e-13) ** 2, 1e-300))) for c in centre])
    floor = lambda at, squares: 1e-11 * F.col(squares) + F.col("n") * F.get(rounding, F.col(at))
    varies = (var_i > floor("i", "sii")) & (var_j > floor("j", "sjj"))
    corr = F.greatest(F.least(covariance / F.sqrt(var_i) / F.sqrt(var_j), F.lit(1.0)), F.lit(-1.0))
    return m.select("i", "j", F.when((F.col("n") > 1) & (F.col("nan") == 0) & varies, corr).alias("corr"))

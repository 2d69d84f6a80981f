"""Ridge regression from sufficient statistics, with every fold's fit from one pass.

Per fold, ``Z'Z`` of the centred rows ``Z = [1, x, y]`` holds all that ridge needs: sums, squares and
products. Tasks add these products over their Arrow batches and the driver gets one small matrix per
fold, of a size that depends on the features alone. The fit that leaves a fold out uses the total less
that fold's matrix, and its error on the fold follows from the fold's own matrix, so no fold is
trained on or scored again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import column_means


def fold_products(df: DataFrame, columns: Sequence[str], fold_col: str) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """``Z'Z`` per fold over the rows without nulls, and the means by which the columns were centred."""
    size = len(columns) + 1
    rows = df.select(F.col(fold_col).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    centre = column_means(rows, [f"c{i}" for i in range(len(columns))])

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            folds = frame["fold"].to_numpy()
            z = np.column_stack([np.ones(len(frame)), frame.iloc[:, 1:].to_numpy(np.float64) - centre])
            for k in np.unique(folds).tolist():
                own = z[folds == k]
                total[k] = total.get(k, 0) + own.T @ own
        for k, t in total.items():
            yield pd.DataFrame({"fold": k, "cell": np.arange(size * size), "value": t.ravel()})

    found = rows.mapInPandas(products, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in found.collect():  # folds x (features + 2)^2 numbers
        out.setdefault(r["fold"], np.zeros(size * size))[r["cell"]] = r["value"]
    return {k: v.reshape(size, size) for k, v in out.items()}, centre


def solve_ridge(products: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights in centred units; the intercept is not penalised."""
    n = products[0, 0]
    means = products[0, 1:] / n
    centred = products[1:, 1:] - n * np.outer(means, means)
    d = len(centred) - 1
    weights = np.linalg.lstsq(centred[:d, :d] + alpha * np.eye(d), centred[:d, d], rcond=None)[0]
    return np.append(means[d] - weights @ means[:d], weights)


def ridge_fold_scores(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold", alpha: float = 1.0) -> dict[int, float | None]:
    """R^2 on each fold of the ridge fitted on the others; ``None`` where the fold's target is constant."""
    folds, _ = fold_products(df, [*features, target], fold_col)
    total = sum(folds.values())
    out: dict[int, float | None] = {}
    for k, own in sorted(folds.items()):
        rest = total - own
        if rest[0, 0] < 0.5:
            out[k] = None
            continue
        line = np.append(solve_ridge(rest, alpha), -1.0)  # prediction less target is a product with Z
        spread = own[-1, -1] - own[0, -1] ** 2 / own[0, 0]
        out[k] = float(1 - (line @ own @ line) / spread) if spread > 1e-12 * own[-1, -1] else None
    return out

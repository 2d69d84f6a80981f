"""Additive attributions (Shapley values) for fitted models, computed next to the data.

Tree ensembles (path-dependent expectation, no background data). For one leaf with value ``v``,
the expected output given a subset ``S`` of known features is ``v * prod_{j in S} o_j *
prod_{j not in S} z_j``, where ``o_j`` says whether the row satisfies every test on ``j`` along the
path and ``z_j`` is the product of the cover ratios of those tests (both 1 for a feature that the
path does not test). The Shapley value of ``i`` for this game is

    phi_i = v * (o_i - z_i) * integral_0^1 prod_{j != i} (z_j (1 - t) + o_j t) dt,

a polynomial in ``t`` whose degree is below the number of features on the path, so a few
Gauss-Legendre nodes integrate it exactly. The model's value is the sum over its leaves. The leaf
arrays come from the fitted model (which Spark ML keeps on the driver; their size depends on the
model, never on the data) and go to the tasks once; every Arrow batch of rows sums its
attributions in place, so there are no pairs of rows and leaves and no shuffle.

Linear models: ``phi_j = w_j * (x_j - mean_j)`` with the means of a background sample. Any
model (``d`` small): exact enumeration of the ``2^d`` coalitions against a background sample.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import ensure_checkpoint_dir
from ..sources.tables import spread

# ---------------------------------------------------------------- leaf arrays


class Leaves(NamedTuple):
    """One row per leaf: a row of data satisfies feature ``j`` iff ``low < x_j <= high``; ``share`` is
    the cover ratio of the tests on it; ``value`` has a column per output, weighted for the ensemble."""

    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def expected(self) -> np.ndarray:
        """The model's mean outputs under the training cover."""
        return self.share.prod(axis=1) @ self.value


def _tree_model(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def node_table(spark, model) -> DataFrame:
    """The saved nodes of an ensemble (written under the shared checkpoint dir)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    cols = [F.col("treeID") if "treeID" in nodes.columns else F.lit(0).alias("treeID")]
    nd = "nodeData." if "nodeData" in nodes.columns else ""
    cols += [F.col(f"{nd}{c}").alias(c) for c in ("id", "prediction", "impurityStats", "leftChild", "rightChild")]
    cols += [F.col(f"{nd}split.featureIndex").alias("f"),
             F.get(F.col(f"{nd}split.leftCategoriesOrThreshold"), 0).alias("thr")]
    return nodes.select(*cols)


def tree_leaves(spark, model, d: int) -> Leaves:
    """The leaves of a fitted ensemble over ``d`` features.

    Random forests average their trees (value / numTrees); boosted trees sum them with the tree
    weights (the margin for classifiers). Forest classifiers have one output per class, its
    probability.
    """
    if isinstance(model, (RandomForestRegressionModel, RandomForestClassificationModel)):
        weights = np.full(model.getNumTrees, 1.0 / model.getNumTrees)
    elif isinstance(model, (GBTRegressionModel, GBTClassificationModel)):
        weights = np.array(model.treeWeights)
    else:
        weights = np.ones(1)
    stats = F.col("impurityStats")
    if isinstance(model, RandomForestClassificationModel):
        cover = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        values = [F.coalesce(F.get(stats, c) / F.nullif(F.col("cover"), F.lit(0.0)), F.lit(0.0)) for c in range(model.numClasses)]
    else:
        cover, values = F.get(stats, 0), [F.col("prediction")]
    nodes = node_table(spark, model).withColumn("cover", cover.cast("double"))
    # Bounded by the model's own size (trees x nodes), which the driver already holds.
    nodes = nodes.select("treeID", "id", "leftChild", "rightChild", "f", "thr", "cover",
                         *[v.alias(f"v{i}") for i, v in enumerate(values)]).toPandas().sort_values(["treeID", "id"])
    tree, node = nodes["treeID"].to_numpy(np.int64), nodes["id"].to_numpy(np.int64)
    wide = int(node.max()) + 1
    place = tree * wide + node  # ascending
    left, right, f = (nodes[c].to_numpy(np.int64) for c in ("leftChild", "rightChild", "f"))
    thr, covers = nodes["thr"].to_numpy(float), nodes["cover"].to_numpy(float)
    value = nodes[[f"v{i}" for i in range(len(values))]].to_numpy(float) * weights[tree][:, None]

    at = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))  # roots; then level by level
    low, high, share = np.full((len(at), d), -np.inf), np.full((len(at), d), np.inf), np.ones((len(at), d))
    found = []
    while len(at):
        leaf = left[at] < 0
        found.append(Leaves(low[leaf], high[leaf], share[leaf], value[at[leaf]]))
        at, low, high, share = at[~leaf], low[~leaf], high[~leaf], share[~leaf]
        rows, feature, cut = np.arange(len(at)), f[at], thr[at]
        parts = []
        for child in (left, right):
            to = np.searchsorted(place, tree[at] * wide + child[at])
            lo, hi, z = low.copy(), high.copy(), share.copy()
            if child is left:
                hi[rows, feature] = np.minimum(hi[rows, feature], cut)
            else:
                lo[rows, feature] = np.maximum(lo[rows, feature], cut)
            z[rows, feature] *= np.divide(covers[to], covers[at], out=np.zeros(len(at)), where=covers[at] > 0)
            parts.append((to, lo, hi, z))
        at, low, high, share = (np.concatenate(p) for p in zip(*parts))
    return Leaves(*(np.concatenate(p) for p in zip(*found)))


def _path_nodes(leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, 1], enough for the longest path."""
    on_path = (np.isfinite(leaves.low) | np.isfinite(leaves.high)).sum(axis=1).max(initial=1)
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-int(on_path) // 2)))
    return (points + 1) / 2, weights / 2


def _shares(meets: list[np.ndarray], share: np.ndarray, points: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """``phi_j / v`` of every row and leaf, for each feature; ``meets[j]`` says (as 0 or 1) whether a row satisfies the leaf's
    tests on ``j``."""
    d = len(meets)
    total = [np.zeros(meets[0].shape) for _ in range(d)]
    for t, w in zip(points, weights):
        factor = [share[:, j] * (1 - t) + meets[j] * t for j in range(d)]
        before = [np.full(meets[0].shape, w)]
        for j in range(d - 1):
            before.append(before[-1] * factor[j])
        after = 1.0
        for j in reversed(range(d)):
            total[j] += before[j] * after
            after = after * factor[j]
    return [(meets[j] - share[:, j]) * total[j] for j in range(d)]


def leaf_sums(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Attributions ``(rows, features, outputs)`` of the rows ``x``; memory is bounded by the blocks.

    A leaf's part of a row's attributions depends on nothing but which features' tests the row meets. With
    ``2^d`` such patterns no more than rows, every pattern is worked out once a leaf and rows look theirs up;
    with more of them, row by row."""
    d = x.shape[1]
    if 2**d <= len(x):
        return _pattern_sums(x, leaves)
    phi = np.zeros((len(x), d, leaves.value.shape[1]))
    points, weights = _path_nodes(leaves)
    for a in range(0, len(leaves.low), 2048):
        low, high, share, value = (part[a : a + 2048] for part in leaves)
        for r in range(0, len(x), 64):
            rows = x[r : r + 64]
            meets = [((rows[:, j, None] > low[:, j]) & (rows[:, j, None] <= high[:, j])).astype(float) for j in range(d)]
            for j, part in enumerate(_shares(meets, share, points, weights)):
                phi[r : r + 64, j] += part @ value
    return phi


def _pattern_sums(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    d, outputs = x.shape[1], leaves.value.shape[1]
    phi = np.zeros((len(x), d * outputs))
    points, weights = _path_nodes(leaves)
    columns = [np.ascontiguousarray(x[:, j]) for j in range(d)]
    patterns = [(np.arange(2**d) >> j & 1).astype(float)[:, None] for j in range(d)]
    kind = np.min_scalar_type(2**d - 1)
    some_leaves = max(1, (1 << 17) >> d)
    for a in range(0, len(leaves.low), some_leaves):
        low, high, share, value = (part[a : a + some_leaves] for part in leaves)
        n = len(low)
        parts = _shares([np.broadcast_to(p, (2**d, n)) for p in patterns], share, points, weights)
        table = np.stack([p[:, :, None] * value for p in parts], axis=2).transpose(1, 0, 2, 3).reshape(n, 2**d, d * outputs)
        # a row's side of every test: one lookup a feature, by its place among the block's thresholds
        cuts = [np.unique(np.concatenate([low[:, j], high[:, j]])) for j in range(d)]
        place = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, columns)]
        bits = []
        for j, c in enumerate(cuts):
            at = np.arange(len(c) + 1)[None]
            inside = (at > np.searchsorted(c, low[:, j])[:, None]) & (at <= np.searchsorted(c, high[:, j])[:, None])
            bits.append(inside.astype(kind) << j)
        for leaf in range(n):
            pattern = bits[0][leaf].take(place[0])
            for j in range(1, d):
                pattern |= bits[j][leaf].take(place[j])
            phi += table[leaf].take(pattern, axis=0)
    return phi.reshape(len(x), d, outputs)


def _attributions(df: DataFrame, ensembles: list[Leaves], feature_cols: Sequence[str], id_col: str, classes: bool) -> DataFrame:
    """Long attributions for every output of the ensembles, in order."""
    d = len(feature_cols)
    base = np.concatenate([e.expected() for e in ensembles])

    def attribute(batches):
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            phi = np.concatenate([leaf_sums(x, e) for e in ensembles], axis=2)
            ends = pa.array(np.arange(len(x) + 1) * phi[0].size if len(x) else [0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))],
                                             names=[id_col, "__phi"])

    rows = df.select(F.col(id_col), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feature_cols)])
    schema = StructType([rows.schema[0], StructField("__phi", ArrayType(DoubleType()))])
    out = [F.struct(*([F.lit(c).alias("class")] if classes else []), F.lit(name).alias("feature"),
                    F.get("__phi", i * len(base) + c).alias("shap_value"), F.lit(float(base[c])).alias("base_value"))
           for i, name in enumerate(feature_cols) for c in range(len(base))]
    return rows.mapInArrow(attribute, schema).select(id_col, F.inline(F.array(*out)))


def tree_shap(df: DataFrame, model, feature_cols: Sequence[str], id_col: str = "row_id",
              class_index: int | None = None) -> DataFrame:
    """Long ``(id, feature, shap_value, base_value)`` for a tree ensemble;
    ``base_value + sum(shap_value) = model output`` (margin for boosted classifiers, for others the
    probability of ``class_index``, 0 if not given).

    Features must be complete (impute first); a missing one satisfies no test."""
    m, output = _tree_model(model), class_index or 0
    if isinstance(m, OneVsRestModel):  # the margin of one class's binary sub-model
        m, output = m.models[output], 0
    leaves = tree_leaves(df.sparkSession, m, len(feature_cols))
    if not isinstance(m, RandomForestClassificationModel):
        output = 0
    return _attributions(df, [leaves._replace(value=leaves.value[:, [output]])], feature_cols, id_col, classes=False)


def class_shap(df: DataFrame, model, feature_cols: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """``tree_shap`` of every class in one pass, with the class's index in ``class``."""
    m = _tree_model(model)
    models = m.models if isinstance(m, OneVsRestModel) else [m]
    ensembles = [tree_leaves(df.sparkSession, one, len(feature_cols)) for one in models]
    return _attributions(df, ensembles, feature_cols, id_col, classes=True)


# ---------------------------------------------------------------- linear and model-agnostic


def background_sample(df: DataFrame, n: int = 100, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """A deterministic background of at most ``n`` rows (those of the ``n`` smallest seeded digests of their ids;
    a sampling operator, so the limit is the feature)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def linear_shap(df: DataFrame, weights: dict[str, float], background: DataFrame, id_col: str = "row_id",
                intercept: float = 0.0) -> DataFrame:
    """``phi_j = w_j * (x_j - mean_j)`` over background means; long output with ``base_value``."""
    feats = list(weights)
    means = background.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(feats)])
    base = sum([F.lit(weights[c]) * F.col(f"__m{i}") for i, c in enumerate(feats)], F.lit(intercept))
    j = df.select(id_col, *feats).crossJoin(F.broadcast(means))
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             (F.lit(weights[c]) * (F.col(c).cast("double") - F.col(f"__m{i}"))).alias("shap_value"))
                    for i, c in enumerate(feats)])
    return j.select(id_col, F.inline(arr), base.alias("base_value"))


def linear_weights(model, feature_cols: Sequence[str]) -> tuple[dict[str, float], float]:
    m = _tree_model(model)
    return dict(zip(feature_cols, [float(v) for v in m.coefficients.toArray()])), float(m.intercept)


def _linear_scorer(model, feature_cols: Sequence[str]) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of a model that only assembles these features and scores them linearly, else nothing."""
    stages = model.stages if isinstance(model, PipelineModel) else []
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], LinearRegressionModel):
        return None
    first, last = stages
    if first.getInputCols() != list(feature_cols) or first.getOutputCol() != last.getFeaturesCol() \
            or first.getHandleInvalid() != "keep" or last.getPredictionCol() != "prediction":
        return None
    return last.coefficients.toArray(), float(last.intercept)


def _coalition_weights(d: int) -> np.ndarray:
    """``(2^d, d)``: phi_i weighs v(S) by w(|S| - 1) where S holds i and by -w(|S|) where it does not."""
    weight = [math.factorial(m) * math.factorial(d - m - 1) / math.factorial(d) for m in range(d)]
    return np.array([[weight[s.bit_count() - 1] if s >> i & 1 else -weight[s.bit_count()] for i in range(d)] for s in range(2**d)])


def _linear_grid(df: DataFrame, weights: np.ndarray, intercept: float, feature_cols: Sequence[str], background: DataFrame,
                 id_col: str) -> DataFrame:
    """``exact_shap`` of a linear model: every coalition with every background row is scored in Arrow batches, one scan
    and no row per cell of the grid. Rows of one id are averaged, as their scores are in the general form."""
    d = len(feature_cols)
    cols = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feature_cols)]
    names = [f"__x{i}" for i in range(d)]
    bg = np.array([[np.nan if v is None else v for v in r] for r in background.select(*cols).collect()]).reshape(-1, d)  # a bounded sample
    share, on = _coalition_weights(d), np.arange(2**d)[:, None] >> np.arange(d) & 1 == 1

    def score(batches):
        for b in batches:
            if not b.num_rows or not len(bg):
                continue
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1) * weights
            values = np.empty((len(x), 2**d))
            for s in range(2**d):
                own, other = x[:, on[s]].sum(axis=1) + intercept, (bg * weights)[:, ~on[s]].sum(axis=1)
                values[:, s] = (own[:, None] + other).mean(axis=1)
            phi = values @ share
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(phi[:, i]) for i in range(d)], pa.array(values[:, 0])],
                                             names=["__id", *[f"__p{i}" for i in range(d)], "__base"])

    rows = spread(df.select(F.col(id_col).alias("__id"), *cols))
    kind = rows.schema["__id"].dataType
    found = rows.mapInArrow(score, StructType([StructField("__id", kind), *[StructField(f"__p{i}", DoubleType()) for i in range(d)],
                                               StructField("__base", DoubleType())]))
    one = found.groupBy("__id").agg(*[F.avg(f"__p{i}").alias(f"__p{i}") for i in range(d)], F.avg("__base").alias("__base"))
    return one.select(F.col("__id").alias(id_col), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"__p{i}").alias("shap_value"), F.col("__base").alias("base_value"))
        for i, c in enumerate(feature_cols)])))


def exact_shap(df: DataFrame, model, feature_cols: Sequence[str], background: DataFrame, id_col: str = "row_id",
               output: str = "prediction", max_features: int = 10) -> DataFrame:
    """Model-agnostic exact Shapley values: every coalition ``S`` of the ``d <= max_features``
    features (the limit of exact enumeration) is scored as the mean model output over the
    background with ``x_S`` fixed.

    Rows x 2^d x background rows are scored by ``model.transform`` in one pass; the background is a
    bounded sample and is broadcast. Rows are spread by id first, so both aggregates stay in their
    partition; each row's 2^d means then meet fixed weights in one array. A linear model's scores of the same grid are
    worked out in place, a batch of rows at a time (``_linear_grid``)."""
    d = len(feature_cols)
    if d > max_features:
        raise ValueError(f"exact enumeration needs at most {max_features} features, got {d}")
    linear = _linear_scorer(model, feature_cols) if output == "prediction" else None
    if linear is not None:
        return _linear_grid(df, *linear, feature_cols, background, id_col)
    masks = df.sparkSession.range(2 ** d).select(F.col("id").cast("int").alias("__mask"))
    bg = background.select(*[F.col(c).cast("double").alias(f"__b{i}") for i, c in enumerate(feature_cols)])
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in feature_cols]).repartition(id_col)
    grid = rows.crossJoin(F.broadcast(masks)).crossJoin(F.broadcast(bg))
    mixed = grid.select(id_col, "__mask", *[
        F.when(F.col("__mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.col(f"__b{i}")).alias(c)
        for i, c in enumerate(feature_cols)])
    means = model.transform(mixed).groupBy(id_col, "__mask").agg(F.avg(output).alias("v"))
    values = means.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("__mask", "v")))["v"].alias("__v"))
    share = _coalition_weights(d)

    def phi(i: int) -> Column:
        terms = F.zip_with("__v", F.array(*[F.lit(w) for w in share[:, i].tolist()]), lambda v, w: v * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    out = F.array(*[F.struct(F.lit(c).alias("feature"), phi(i).alias("shap_value"), F.get("__v", 0).alias("base_value"))
                    for i, c in enumerate(feature_cols)])
    return values.select(id_col, F.inline(out))


def kernel_weights(d: int, samples: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions ``(m, d)`` and coefficients ``(m + 2, d)``: a row's attributions are the coefficients times the values
    of no features, all features and each coalition.

    The values are explained by a regression on membership, weighed by the Shapley kernel and bound to
    add up. Its solution is linear in the values, so the coefficients are the same for every row. All
    coalitions are taken where ``samples`` allows it, which makes the attributions exact; else
    sizes are drawn by their share of the kernel, each coalition along with its complement."""
    if d == 1:
        return np.zeros((0, 1), bool), np.array([[-1.0], [1.0]])
    if d < 31 and 2**d - 2 <= samples:
        z = (np.arange(1, 2**d - 1)[:, None] >> np.arange(d) & 1).astype(bool)
        size = z.sum(axis=1)
        w = np.array([(d - 1) / (math.comb(d, s) * s * (d - s)) for s in size.tolist()])
    else:
        rng = np.random.default_rng(seed)
        share = np.array([1 / (s * (d - s)) for s in range(1, d)])
        sizes = rng.choice(np.arange(1, d), size=max(1, samples // 2), p=share / share.sum())
        z = np.zeros((2 * len(sizes), d), bool)
        for i, s in enumerate(sizes.tolist()):
            z[2 * i, rng.permutation(d)[:s]] = True
            z[2 * i + 1] = ~z[2 * i]
        z, count = np.unique(z, axis=0, return_counts=True)
        w = count.astype(np.float64)
    weighed = z.T * w
    inverse = np.linalg.pinv(weighed @ z)
    g = inverse.sum(axis=1)
    a = (np.eye(d) - np.outer(g, np.ones(d)) / g.sum()) @ inverse @ weighed
    c = g / g.sum()
    return z, np.vstack([-(a.sum(axis=1) + c), c, a.T])


def kernel_shap(df: DataFrame, model, feature_cols: Sequence[str], background: DataFrame, id_col: str = "row_id",
                output: str = "prediction", samples: int = 2048, seed: int = 42) -> DataFrame:
    """Model-agnostic Shapley values for any number of features, by kernel-weighted regression over coalitions
    (``kernel_weights``): exact up to ten features with the default ``samples``, sampled beyond. Rows add up
    to the prediction in either case.

    Rows x coalitions x background rows are scored by ``model.transform`` in one pass; coalitions and background
    are bounded and broadcast. Rows are spread by id first, so both aggregates stay in their partition."""
    spark, d = df.sparkSession, len(feature_cols)
    z, coefficients = kernel_weights(d, samples, seed)
    on = np.vstack([np.zeros((1, d), bool), np.ones((1, d), bool), z])
    coalitions = spark.createDataFrame([(i, on[i].tolist(), coefficients[i].tolist()) for i in range(len(on))],
                                       "__mask int, __on array<boolean>, __coef array<double>")
    bg = background.select(*[F.col(c).cast("double").alias(f"__b{i}") for i, c in enumerate(feature_cols)])
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in feature_cols]).repartition(id_col)
    grid = rows.crossJoin(F.broadcast(coalitions.drop("__coef"))).crossJoin(F.broadcast(bg))
    mixed = grid.select(id_col, "__mask", *[
        F.when(F.get("__on", F.lit(i)), F.col(c)).otherwise(F.col(f"__b{i}")).alias(c) for i, c in enumerate(feature_cols)])
    means = model.transform(mixed).groupBy(id_col, "__mask").agg(F.avg(output).alias("__value"))
    weighed = means.join(F.broadcast(coalitions.select("__mask", "__coef")), "__mask")
    found = weighed.groupBy(id_col).agg(
        *[F.sum(F.col("__value") * F.get("__coef", F.lit(i))).alias(f"__phi{i}") for i in range(d)],
        F.sum(F.when(F.col("__mask") == 0, F.col("__value"))).alias("__base"))
    return found.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"__phi{i}").alias("shap_value"), F.col("__base").alias("base_value"))
        for i, c in enumerate(feature_cols)])))


# ---------------------------------------------------------------- summaries (EXP-3..6, CHT-12..14)


def shap_importance(phi: DataFrame, by_class: bool = False) -> DataFrame:
    """Mean and population std of |phi| per feature, desc. With ``by_class``, a row's |phi| is first
    averaged over its classes, so that classes of opposite sign don't cancel."""
    x = phi
    if by_class and "class" in phi.columns:
        x = phi.groupBy(*[c for c in phi.columns if c not in ("class", "shap_value", "base_value")]).agg(
            F.avg(F.abs("shap_value")).alias("shap_value"))
    return x.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("importance"),
                                    F.stddev_pop(F.abs("shap_value")).alias("std")).orderBy(
        F.desc("importance"), "feature")


def _long_values(values: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    return values.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value")) for c in features])))


def explain_rows(phi: DataFrame, id_col: str = "row_id", top: int = 5, values: DataFrame | None = None) -> DataFrame:
    """Per row: prediction (= base + sum phi), base, contributions by |phi| desc, the ``top``
    positive and ``top`` negative ones. Each row's group holds ``d`` entries. With ``values`` (the
    explained rows: the id and the features) every contribution has its feature's ``value``."""
    fields = ["feature", "shap_value"]
    if values is not None:
        own = _long_values(values, [c for c in values.columns if c != id_col], id_col)
        phi = phi.join(own.withColumnRenamed("feature_value", "value"), [id_col, "feature"], "left")
        fields.append("value")
    g = phi.groupBy(id_col).agg(
        F.first("base_value").alias("base_value"),
        (F.first("base_value") + F.sum("shap_value")).alias("prediction"),
        F.collect_list(F.struct(F.abs("shap_value").alias("abs"), *fields)).alias("__c"))
    by_abs = F.transform(F.array_sort("__c", lambda a, b: F.when(a["abs"] > b["abs"], -1).when(
        a["abs"] < b["abs"], 1).otherwise(F.when(a["feature"] < b["feature"], -1).otherwise(1))),
        lambda e: F.struct(*[e[c].alias(c) for c in fields]))
    pos = F.slice(F.filter(by_abs, lambda e: e["shap_value"] > 0), 1, top)
    neg = F.slice(F.filter(by_abs, lambda e: e["shap_value"] < 0), 1, top)
    return g.select(id_col, "prediction", "base_value", by_abs.alias("contributions"),
                    pos.alias("top_positive"), neg.alias("top_negative"))


def _money(c: Column, currency: bool) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0)) if currency else F.format_number(c, 2)


def explanation_text(explained: DataFrame, id_col: str = "row_id", currency: bool = True, n: int = 3) -> DataFrame:
    """Readable explanation per row: header, up to ``n`` features raising and lowering it."""
    def lines(arr: str, sign: str) -> Column:
        return F.array_join(F.transform(F.slice(F.col(arr), 1, n), lambda e: F.concat(
            F.lit("  - "), e["feature"], F.lit(": "), F.lit(sign), _money(F.abs(e["shap_value"]), currency))), "\n")

    txt = F.concat_ws("\n",
                      F.concat(F.lit("Predicted value: "), _money(F.col("prediction"), currency)),
                      F.concat(F.lit("Base value: "), _money(F.col("base_value"), currency)),
                      F.lit(""), F.lit("Factors increasing the prediction:"), lines("top_positive", "+"),
                      F.lit(""), F.lit("Factors decreasing the prediction:"), lines("top_negative", "-"))
    return explained.select(id_col, txt.alias("text"))


def importance_normalized(importance: DataFrame) -> DataFrame:
    """Importance and its share of the total (the importance table has one row per feature)."""
    tot = importance.agg(F.sum("importance").alias("__t"))
    return importance.crossJoin(F.broadcast(tot)).select(
        "feature", "importance", (F.col("importance") / F.nullif(F.col("__t"), F.lit(0.0))).alias("share")) \
        .orderBy(F.desc("importance"), "feature")


def shap_summary(phi: DataFrame, values: DataFrame | None = None, kind: str = "bar", max_display: int = 10,
                 id_col: str = "row_id") -> DataFrame:
    """``bar``: top ``max_display`` features by mean |phi|. ``dot``: long (feature, value, phi)
    for those features, values taken from ``values`` (the explained rows)."""
    imp = shap_importance(phi).limit(max_display)
    if kind == "bar":
        return imp.select("feature", F.col("importance").alias("mean_abs_shap"))
    feats = [r[0] for r in imp.select("feature").collect()]
    long_vals = _long_values(values, feats, id_col)
    return phi.join(F.broadcast(imp.select("feature")), "feature", "left_semi").join(long_vals, [id_col, "feature"])


def shap_dependence(phi: DataFrame, values: DataFrame, feature: str, interaction: str | None = None,
                    id_col: str = "row_id") -> DataFrame:
    """Per row: the feature's value, its phi and (optionally) another feature's value."""
    p = phi.where(F.col("feature") == feature).select(id_col, "shap_value")
    cols = [id_col, F.col(feature).cast("double").alias("feature_value")]
    if interaction:
        cols.append(F.col(interaction).cast("double").alias("interaction_value"))
    return p.join(values.select(*cols), id_col)


def shap_force(phi: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Per row and feature, ordered by |phi| desc: phi and the running total from the base."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap_value")), "feature") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return phi.select(id_col, "feature", "shap_value", "base_value",
                      (F.col("base_value") + F.sum("shap_value").over(w)).alias("cumulative"),
                      F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap_value")), "feature"))
                      .alias("order"))

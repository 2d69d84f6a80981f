"""Multiclass gradient boosting in one model: a tree per class and round on softmax gradients.

Features are cut into bins once (edges from a bounded-memory sketch) and rows are packed into blocks of
small integers with their scores, written to the shared folder. A level of all classes' trees is one job: every
task adds gradients and curvatures per class, node, feature and bin over its blocks, the sums are combined by
Spark, and the driver picks the splits from a table whose size depends on classes, nodes, features and
bins alone. Scores in the blocks are brought up to date every ``refresh`` rounds, so a task replays few
trees. A lost executor costs its tasks of one level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir

_BLOCK = "n int, bins binary, labels binary, weights binary, scores binary"


@dataclass
class Trees:
    """One round: per class the split feature and last left bin of each inner node (heap order) and the leaf values."""

    feature: np.ndarray  # (classes, 2^depth - 1)
    last: np.ndarray
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (classes, 2^depth)

    def nodes(self, bins: np.ndarray, c: int, levels: int) -> np.ndarray:
        """The node of each row at a level of class ``c``'s tree, from 0."""
        at = np.zeros(len(bins), np.int64)
        for level in range(levels):
            inner = (1 << level) - 1 + at
            at = 2 * at + (bins[np.arange(len(bins)), self.feature[c][inner]] > self.last[c][inner])
        return at

    def add_to(self, scores: np.ndarray, bins: np.ndarray) -> None:
        levels = (self.value.shape[1] - 1).bit_length()
        for c in range(len(self.feature)):
            scores[:, c] += self.value[c][self.nodes(bins, c, levels)]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it; missing values are in bin 0."""
    return np.stack([np.searchsorted(e, np.nan_to_num(x[:, i], nan=-np.inf), side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class SoftmaxBoostingModel:
    feature_cols: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[Trees]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, out = to_bins(x, self.edges), np.tile(self.base, (len(x), 1))
        for r in self.rounds:
            r.add_to(out, bins)
        return out

    def probability(self) -> Column:
        """Class probabilities of a row, as an array."""
        @pandas_udf("array<double>")
        def score(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(list(softmax(self.scores(frame.to_numpy(np.float64)))))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.feature_cols]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction`` (the first of the most probable classes)."""
        out = df.withColumn("probability", self.probability())
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


class SoftmaxBoosting:
    def __init__(self, feature_cols: Sequence[str], rounds: int = 100, depth: int = 5, step: float = 0.1, bins: int = 32, l2: float = 1.0,
                 refresh: int = 10, block_rows: int = 1 << 16):
        self.feature_cols, self.rounds, self.depth, self.step = list(feature_cols), rounds, depth, step
        self.bins, self.l2, self.refresh, self.block_rows = bins, l2, refresh, block_rows

    def _edges(self, df: DataFrame) -> list[np.ndarray]:
        cuts = [i / self.bins for i in range(1, self.bins)]
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 10000).alias(f"e{i}") for i, c in enumerate(self.feature_cols)]).first()
        return [np.unique(np.array(e if e is not None else [], np.float64)) for e in row]

    def _blocks(self, df: DataFrame, label: str, weight: str | None, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
        columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.feature_cols)]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), self.block_rows):
                    x = frame.iloc[at : at + self.block_rows].to_numpy(np.float64)
                    yield pd.DataFrame([{"n": len(x), "bins": to_bins(x[:, 2:], edges).tobytes(), "labels": x[:, 0].astype(np.int32).tobytes(),
                                         "weights": x[:, 1].tobytes(), "scores": np.tile(base, (len(x), 1)).tobytes()}])

        rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), w.alias("w"), *columns)
        return rows.mapInPandas(pack, _BLOCK)

    def _unpack(self, row, classes: int, pending: list[Trees]):
        bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], -1)
        scores = np.frombuffer(row["scores"]).reshape(-1, classes).copy()
        for r in pending:
            r.add_to(scores, bins)
        return bins, np.frombuffer(row["labels"], np.int32), np.frombuffer(row["weights"]), scores

    def _level(self, blocks: DataFrame, classes: int, pending: list[Trees], now: Trees, level: int) -> np.ndarray:
        """Sums of gradients and curvatures ``(2, classes, nodes, features, bins)`` of a level."""
        d, shape = len(self.feature_cols), (2, classes, 1 << level, len(self.feature_cols), self.bins)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for frame in frames:
                for row in frame.to_dict("records"):
                    bins, y, w, scores = self._unpack(row, classes, pending)
                    p = softmax(scores)
                    for c in range(classes):
                        g, h = w * ((y == c) - p[:, c]), w * p[:, c] * (1 - p[:, c])
                        node = now.nodes(bins, c, level)
                        for f in range(d):
                            cell = node * self.bins + bins[:, f]
                            for k, v in enumerate((g, h)):
                                total[k, c, :, f] += np.bincount(cell, v, minlength=self.bins << level).reshape(-1, self.bins)
            cell = np.flatnonzero(total)
            yield pd.DataFrame({"cell": cell, "value": total.ravel()[cell]})

        found = blocks.mapInPandas(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(shape).ravel()
        for r in found:
            out[r["cell"]] = r["value"]
        return out.reshape(shape)

    def _split(self, sums: np.ndarray, now: Trees, level: int) -> None:
        """Write the best splits of a level into ``now``, and below the last one the leaf values."""
        g, h = sums.cumsum(axis=-1)  # left of a cut after each bin
        whole_g, whole_h = g[..., -1:], h[..., -1:]
        worth = lambda a, b: a * a / (b + self.l2)
        gain = worth(g, h) + worth(whole_g - g, whole_h - h) - worth(whole_g, whole_h)
        gain[(h < 1e-3) | (whole_h - h < 1e-3)] = 0.0
        flat = gain.reshape(*gain.shape[:2], -1)
        best, first = flat.argmax(axis=-1), (1 << level) - 1
        for c in range(gain.shape[0]):
            for node in range(gain.shape[1]):
                f, b = divmod(int(best[c, node]), self.bins)
                if flat[c, node].max() <= 1e-12:
                    f, b = 0, self.bins  # no split: all go left
                now.feature[c, first + node], now.last[c, first + node] = f, b
                if level == self.depth - 1:
                    for side in (0, 1):
                        left = (g[c, node, f, min(b, self.bins - 1)], h[c, node, f, min(b, self.bins - 1)])
                        a, z = left if side == 0 else (whole_g[c, node, f, 0] - left[0], whole_h[c, node, f, 0] - left[1])
                        now.value[c, 2 * node + side] = self.step * a / (z + self.l2)

    def fit(self, df: DataFrame, label: str, classes: int, weight: str | None = None) -> SoftmaxBoostingModel:
        """``label``: class numbers from 0."""
        spark = df.sparkSession
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"

        def written(frame: DataFrame, name: str) -> DataFrame:
            frame.write.parquet(f"{folder}/{name}")
            return spark.read.schema(_BLOCK).parquet(f"{folder}/{name}")

        w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
        seen = {int(r[0]): r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).agg(w).collect()}  # a row per class
        share = np.array([seen.get(c, 0.0) + 1e-3 for c in range(classes)])
        base, edges = np.log(share / share.sum()), self._edges(df)
        blocks, pending, rounds = written(self._blocks(df, label, weight, edges, base), "start"), [], []
        for number in range(self.rounds):
            now = Trees(np.zeros((classes, (1 << self.depth) - 1), np.int64), np.full((classes, (1 << self.depth) - 1), self.bins, np.int64),
                        np.zeros((classes, 1 << self.depth)))
            for level in range(self.depth):
                self._split(self._level(blocks, classes, pending, now, level), now, level)
            rounds.append(now)
            pending.append(now)
            if len(pending) == self.refresh and number + 1 < self.rounds:
                old = pending

                def refreshed(frames: Iterator[pd.DataFrame], old=old) -> Iterator[pd.DataFrame]:
                    for frame in frames:
                        yield frame.assign(scores=[self._unpack(r, classes, old)[3].tobytes() for r in frame.to_dict("records")])

                blocks, pending = written(blocks.mapInPandas(refreshed, _BLOCK), f"round-{number}"), []
        return SoftmaxBoostingModel(self.feature_cols, edges, base, rounds)

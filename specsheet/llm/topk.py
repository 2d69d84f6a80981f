"""Exact top-k by inner product with a pivot table.

Pivots are spread out farthest-first over a bounded sample (``sample`` vectors of each length, in hash
order). Every vector's distances to all pivots are stored beside it. For a query q and a vector x the
largest ``|d(q, p) - d(x, p)|`` is a lower bound of their distance, which bounds the inner product from
above by ``(|q|^2 + |x|^2 - bound^2) / 2``. Vectors are ordered by their nearest pivot and packed into
blocks; a block keeps the least and greatest distance to each pivot, so a whole block is passed over for
a query that none of its vectors can serve. Other candidates are evaluated in the order of their bounds,
in steps of growing size, until the bound falls below the k-th best score found, so the answer is exact.

Queries go in chunks of bounded size, broadcast to the tasks that hold the blocks: no vector is
shuffled for a query. A first pass compares each query with the blocks of its own pivot alone; the k-th
scores found are broadcast with the chunk as starting thresholds of the second pass, over the other blocks. A task returns k rows
per query at most.

Cases: a vector that is null, empty or holds a null or non-finite component takes no part, nor does a null
id; vectors of different lengths are not compared; rows with the query's own id are its own; rows of one
id with the same score count once, and a repeated query id asks with the least of its vectors; ties
go to the smaller id; a score beyond 64 bits raises; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vector_search import exact_type, keep_best, pack, pair_scores, quantize, query_chunks, usable

_QUERIES = "dim int, n int, ids binary, vectors binary, distances binary"
_BLOCK = _QUERIES + ", nearest binary, farthest binary"
_FOUND = "query int, vec_id long, score long"
_RESULT = "query_id long, rank int, vec_id long, score long"
FIRST = 64  # candidates evaluated before the first look at the threshold


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors of the sample, each the farthest from those before; the first is the longest."""
    at = int(np.argmax((sample**2).sum(axis=1)))
    chosen, gap = [], np.full(len(sample), np.inf)
    while len(chosen) < n and gap[at] > 0:
        chosen.append(at)
        gap = np.minimum(gap, ((sample - sample[at]) ** 2).sum(axis=1))
        at = int(np.argmax(gap))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances ``(rows, pivots)``, a pivot at a time."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def pick_pivots(rows: DataFrame, scale: float, n_pivots: int, sample: int) -> dict[int, np.ndarray]:
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("embedding", "vec_id"))  # limited in each task before the shuffle
    drawn: dict[int, list] = {}
    for r in rows.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample).select("dim", "embedding").toLocalIterator():
        drawn.setdefault(r["dim"], []).append(r["embedding"])
    return {dim: spread_pivots(quantize(np.array(v), scale), n_pivots) for dim, v in drawn.items()}


def with_cells(rows: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """The rows with their nearest pivot (``cell``) and the distance to it (``near``)."""

    def assign(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            cell, near = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            dims = frame["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                d = distances(quantize(np.stack(frame["embedding"].to_numpy()[at]), scale), pivots[dim])
                cell[at], near[at] = d.argmin(axis=1), d.min(axis=1)
            yield frame.assign(cell=cell, near=near)

    return rows.mapInPandas(assign, "vec_id long, dim int, embedding array<double>, cell int, near double")


class Block:
    """Vectors of one length with their distances to the pivots (one row per pivot); in single precision where
    their products are exact in it."""

    def __init__(self, row):
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), -1)
        self.short = self.x.astype(np.float32) if np.abs(self.x).max(initial=0) ** 2 * self.dim < 1 << 24 else self.x
        self.to_pivot = np.frombuffer(row["distances"], "<f4").reshape(-1, len(self.ids))
        self.cell = self.to_pivot.argmin(axis=0)
        self.square = (self.x**2).sum(axis=1)


def block_bounds(q: Block, row, most: float) -> np.ndarray:
    """For each query the most that any vector of a block can score; ``most``: its largest squared length."""
    least, greatest = (np.frombuffer(row[c], "<f4")[:, None] for c in ("nearest", "farthest"))
    gap = np.maximum(q.to_pivot - greatest, least - q.to_pivot).max(axis=0)
    return _score_bound(q.square, most, np.maximum(gap, 0))


def _score_bound(q_square, x_square, gap):
    lengths = q_square + x_square
    return (lengths - gap**2) / 2 + 1e-5 * lengths + 0.5  # slack above any rounding of single-precision distances


def search_block(q: Block, rows: Block, which: np.ndarray, best: tuple[np.ndarray, ...], floor: np.ndarray, k: int) -> tuple[tuple, np.ndarray, int]:
    """``best`` (query number, score, id) and thresholds after the queries ``which`` have met a block, and
    the number of candidates evaluated."""
    keys, scores, ids, evaluated = [best[0]], [best[1]], [best[2]], 0
    exact = exact_type(q.x, rows.x) is np.float64
    short = q.short.dtype == rows.short.dtype == np.float32 and np.abs(q.x).max() * np.abs(rows.x).max() * q.dim < 1 << 24
    x, asked = (rows.short, q.short) if short else (rows.x, q.x)
    begin = np.searchsorted(best[0], which)
    end = np.searchsorted(best[0], which, side="right")
    for i, b, e in zip(which.tolist(), begin.tolist(), end.tolist()):
        bound = _score_bound(q.square[i], rows.square, np.abs(rows.to_pivot - q.to_pivot[:, i, None]).max(axis=0))
        bound[rows.ids == q.ids[i]] = -np.inf
        left = np.flatnonzero(bound >= floor[i])
        own_score, own_id = best[1][b:e], best[2][b:e]
        take = max(FIRST, k)
        while len(left):
            if len(left) > take:  # those of the highest bounds
                order = np.argpartition(-bound[left], take)
                some, left = left[order[:take]], left[order[take:]]
            else:
                some, left = left, left[:0]
            new = (x[some] @ asked[i]).astype(np.int64) if exact else pair_scores(q.x[i : i + 1], rows.x, np.zeros(len(some), np.int64), some)
            evaluated += len(some)
            good = new >= floor[i]
            if good.any():
                own_score, own_id = np.append(own_score, new[good]), np.append(own_id, rows.ids[some[good]])
                _, own_score, own_id = keep_best(np.zeros(len(own_id), np.int64), own_score, own_id, k)
                if len(own_score) == k:
                    floor[i] = max(floor[i], own_score[-1])
            left, take = left[bound[left] >= floor[i]], 8 * take
        keys.append(np.full(len(own_id), i))
        scores.append(own_score)
        ids.append(own_id)
    return keep_best(np.concatenate(keys), np.concatenate(scores), np.concatenate(ids), k), floor, evaluated


def search_chunk(blocks: DataFrame, queries: list, starts: np.ndarray, k: int, own_cell: bool) -> DataFrame:
    """``query`` (its number in the chunk), ``vec_id`` and ``score`` of the best rows that each task has, in blocks
    that hold vectors of the query's cell, or else in all others."""
    sent = blocks.sparkSession.sparkContext.broadcast((queries, starts))

    def search(frames: Iterator[pd.DataFrame]):
        rows_of, at = [], 0
        packed, begin = sent.value
        for row in packed:
            rows_of.append((at, Block(row)))
            at += row["n"]
        state = {at: ((np.zeros(0, np.int64),) * 3, begin[at : at + len(q.ids)].copy()) for at, q in rows_of}
        for frame in frames:
            for row in frame.to_dict("records"):
                block = Block(row)
                for at, q in rows_of:
                    if q.dim != block.dim:
                        continue
                    best, floor = state[at]
                    may = np.isin(q.cell, np.unique(block.cell)) == own_cell
                    which = np.flatnonzero(may & (block_bounds(q, row, block.square.max()) >= floor))
                    best, floor, _ = search_block(q, block, which, best, floor, k)
                    state[at] = best, floor
        for at, ((key, score, ids), _) in state.items():
            if len(key):
                yield pd.DataFrame({"query": (key + at).astype(np.int32), "vec_id": ids, "score": score})

    return blocks.mapInPandas(search, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, n_pivots: int = 32, sample: int = 4096,
          block_values: int = 1 << 18, chunk_values: int = 1 << 22) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query. Both frames have
    ``vec_id`` and ``embedding``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = usable(vectors)
    pivots = pick_pivots(rows, scale, n_pivots, sample)
    if not pivots:
        return spark.createDataFrame([], _RESULT)

    def build(dim, columns, with_range):
        x = quantize(columns["embedding"], scale)
        to_pivot = distances(x, pivots[dim]).T.astype("<f4")
        out = {"dim": dim, "n": len(x), "ids": columns["vec_id"].astype("<i8").tobytes(), "vectors": x.tobytes(), "distances": to_pivot.tobytes()}
        return out | ({"nearest": to_pivot.min(axis=1).tobytes(), "farthest": to_pivot.max(axis=1).tobytes()} if with_range else {})

    in_cells = with_cells(rows, pivots, scale).repartitionByRange("dim", "cell", "near", "vec_id").sortWithinPartitions("dim", "cell", "near", "vec_id")
    blocks = scratch.table(pack(in_cells, _BLOCK, lambda d, c: build(d, c, True), block_values), "blocks")
    asked = usable(queries).where(F.col("dim").isin(list(pivots))).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    asked = pack(asked, _QUERIES, lambda d, c: build(d, c, False), block_values)

    found = None
    for number, chunk in enumerate(query_chunks(asked, scratch, "queries", chunk_values)):
        ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in chunk])
        lowest = np.full(len(ids), -(1 << 62) * 2, np.int64)
        first = scratch.table(search_chunk(blocks, chunk, lowest, k, own_cell=True), f"first-{number}")
        place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        kth = first.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k)
        for r in kth.select("query", "score").toLocalIterator():  # one row per query of the chunk
            lowest[r["query"]] = r["score"]
        best = first.unionByName(search_chunk(blocks, chunk, lowest, k, own_cell=False)).distinct()
        best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pd.DataFrame({"own": np.arange(len(ids), dtype=np.int32), "query_id": ids}))
        part = scratch.table(best.join(F.broadcast(names), F.col("query") == F.col("own")).select("query_id", "rank", "vec_id", "score"),
                             f"found-{number}", k * len(ids))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _RESULT)

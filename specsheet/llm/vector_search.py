"""Shared parts of the vector searches: whole-number vectors, packed blocks, query chunks, best lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .scratch import Scratch


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """``vec_id``, ``dim``, ``embedding`` (doubles) and the columns ``more`` of rows with an id and a whole
    vector."""
    values = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values, *more)
    whole = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    return rows.select("vec_id", F.size("embedding").alias("dim"), "embedding", *more)


def quantize(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def exact_type(*vectors: np.ndarray) -> type:
    """A type in which sums of products of these integers are exact."""
    top = max(float(np.abs(v).max(initial=0.0)) for v in vectors)
    return np.float64 if top * top * vectors[0].shape[1] < 1 << 53 else object


def as_exact(vectors: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return vectors
    return np.array([int(c) for c in vectors.ravel()], object).reshape(vectors.shape)


def whole_scores(scores: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers; one that does not fit raises."""
    if scores.dtype == object and any(abs(s) >= 1 << 63 for s in scores.tolist()):
        raise OverflowError("a score does not fit 64 bits")
    return scores.astype(np.int64)


def pair_scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows ``q[a]`` and ``x[r]``."""
    kind = exact_type(q, x)
    q, x = as_exact(q, kind), as_exact(x, kind)
    step = max(1, (1 << 20) // q.shape[1])
    parts = [whole_scores((q[a[at : at + step]] * x[r[at : at + step]]).sum(axis=1)) for at in range(0, len(a), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def keep_best(key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Per key the ``k`` highest scores, ties to the smaller id, sorted so; rows equal in all three count
    once."""
    order = np.lexsort((vec_id, -score, key))
    key, score, vec_id = key[order], score[order], vec_id[order]
    if len(key):
        new = np.append(True, (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (vec_id[1:] != vec_id[:-1]))
        key, score, vec_id = key[new], score[new], vec_id[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        key, score, vec_id = key[rank < k], score[rank < k], vec_id[rank < k]
    return key, score, vec_id


def floors(key: np.ndarray, score: np.ndarray, k: int, start: np.ndarray) -> np.ndarray:
    """The ``k``-th best score of each key (of sorted best lists), or its start value."""
    out = start.copy()
    if len(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        full = np.diff(np.append(first, len(key))) >= k
        at = first[full] + k - 1
        out[key[at]] = np.maximum(out[key[at]], score[at])
    return out


def pack(rows: DataFrame, schema: str, build: Callable[[int, dict[str, np.ndarray]], dict], block_values: int, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per block of up to ``block_values`` components of vectors of one length, in the order of the
    rows: what ``build(dim, columns)`` returns."""

    def blocks(frames: Iterator[pd.DataFrame]):
        waiting: dict[int, list[tuple]] = {}
        held = 0

        def flush(dim: int) -> pd.DataFrame:
            ids, values, *rest = zip(*waiting.pop(dim))
            columns = {"vec_id": np.array(ids, np.int64), "embedding": np.array(values, np.float64)}
            return pd.DataFrame([build(dim, columns | {c: np.array(v) for c, v in zip(more, rest)})])

        for frame in frames:
            for row in zip(frame["dim"].tolist(), frame["vec_id"].tolist(), frame["embedding"], *[frame[c].tolist() for c in more]):
                dim = row[0]
                waiting.setdefault(dim, []).append(row[1:])
                held += dim
                if len(waiting[dim]) * dim >= block_values:
                    held -= len(waiting[dim]) * dim
                    yield flush(dim)
                elif held > 2 * block_values:  # many lengths: the fullest goes
                    dim = max(waiting, key=lambda d: d * len(waiting[d]))
                    held -= len(waiting[dim]) * dim
                    yield flush(dim)
        for dim in sorted(waiting):
            yield flush(dim)

    return rows.select("dim", "vec_id", "embedding", *more).mapInPandas(blocks, schema)


def query_chunks(blocks: DataFrame, scratch: Scratch, name: str, chunk_values: int) -> Iterator[list[Row]]:
    """The packed query blocks (``dim``, ``n`` and others) in chunks of ``chunk_values`` components at most,
    or of one block: only one chunk is on the driver at a time."""
    table = scratch.table(blocks.withColumn("query_block", F.monotonically_increasing_id()), name)
    chunk, held = [], 0
    for b in table.select("query_block", (F.col("dim") * F.col("n")).alias("values")).orderBy("query_block").toLocalIterator():
        if chunk and held + b["values"] > chunk_values:
            yield table.where(F.col("query_block").isin(chunk)).orderBy("query_block").collect()
            chunk, held = [], 0
        chunk.append(b["query_block"])
        held += b["values"]
    if chunk:
        yield table.where(F.col("query_block").isin(chunk)).orderBy("query_block").collect()

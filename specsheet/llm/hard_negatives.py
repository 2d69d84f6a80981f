"""Hard negatives by rotated one-bit codes with a deterministic interval around each inner product.

Every vector is rotated (seeded sign flips and Walsh-Hadamard transforms, padded to a power of two) and
scaled to length one; its code ``b`` is the sign of each component, and its alignment ``a`` with the code
is stored beside it. What the code misses is orthogonal to it and has length ``sqrt(1 - a^2)``. For an
anchor, rotated alike and rounded to a few bit planes, popcounts of code and planes give its product
``t`` with the code up to the rounding's length; by Cauchy-Schwarz the true inner product lies within
``sqrt(|q|^2 - t^2) sqrt(1 - a^2)`` of ``a t``. That interval holds always, not just likely, so a
candidate outside all that is asked for is dropped without being looked at, and the others are scored
on whole numbers.

Anchors go in chunks of bounded size, broadcast to the tasks that hold the packed vectors. One pass finds
an anchor's best rows of its own label, its positives. Each positive's score makes a window of wanted
negative scores; a second pass keeps, per window, the best rows of other labels, and its interval
test uses the windows and the running k-th scores. A task returns a bounded number of rows per anchor.

Cases: a row with a null id or label, or a vector that is null, empty or holds a null or non-finite
component takes no part; labels are whole numbers; vectors of different lengths are not compared; rows
with the anchor's own id are its own; rows of one id and label with the same score count once, and a
repeated anchor id asks with its least label and vector; ties go to the smaller id; a negative score has no
window, since 0.8 of it lies above it; a score beyond 64 bits raises; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vector_search import floors, keep_best, pack, pair_scores, quantize, query_chunks, usable

PLANES = 6  # bits of a rounded anchor component
SEED = 20
_BLOCK = "dim int, n int, ids binary, labels binary, vectors binary, codes binary, alignments binary, lengths binary"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LOWEST = -(1 << 63)


def rotate(x: np.ndarray) -> np.ndarray:
    """Rotated rows, padded with zeros to a power of two and to 64 at least."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng(SEED)
    for _ in range(2):
        out *= rng.integers(0, 2, size) * 2.0 - 1
        step = 1
        while step < size:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def bit_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; their number is a multiple of 64."""
    return np.packbits(bits, axis=1).view(np.uint64)


def one_bit_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment of the unit vector with its code, and length of each row."""
    rotated = rotate(x)
    length = np.sqrt((x**2).sum(axis=1))
    aligned = np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1]) / np.where(length > 0, length, 1)
    return bit_words(rotated >= 0), np.where(length > 0, np.minimum(aligned, 1.0), 1.0), length


class Planes:
    """Rotated queries rounded to ``PLANES`` bits a component, as bit planes."""

    def __init__(self, x: np.ndarray):
        u = rotate(x)
        self.size, self.length = u.shape[1], np.sqrt((x**2).sum(axis=1))
        self.low = u.min(axis=1)
        self.step = np.maximum(u.max(axis=1) - self.low, 1e-300) / ((1 << PLANES) - 1)
        whole = np.clip(np.rint((u - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1)
        rounded = self.low[:, None] + whole * self.step[:, None]
        self.missing = np.sqrt(((u - rounded) ** 2).sum(axis=1))
        self.total = rounded.sum(axis=1)
        whole = whole.astype(np.int64)
        self.planes = [bit_words((whole >> b & 1).astype(bool)) for b in range(PLANES)]

    def intervals(self, some: np.ndarray, codes: np.ndarray, alignment: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of the queries ``some`` with coded rows."""
        weighted = np.zeros((len(some), len(codes)), np.int32)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                weighted += np.bitwise_count(plane[some, w][:, None] & codes[None, :, w]).astype(np.int32) << b
        q_length = self.length[some][:, None]
        inside = self.low[some][:, None] * ones[None] + self.step[some][:, None] * weighted  # of components with a one
        t = (2 * inside - self.total[some][:, None]) / np.sqrt(self.size)
        missing = self.missing[some][:, None]
        least = np.maximum(np.abs(t) - missing, 0)
        residual = np.sqrt(np.maximum(q_length**2 - least**2, 0)) * np.sqrt(np.maximum(1 - alignment**2, 0))[None]
        slack = (1e-9 * (q_length + 1) * (length + 1)[None]) + 1e-6  # far above any rounding
        spread = (alignment[None] * missing + residual) * length[None] + slack
        middle = alignment[None] * t * length[None]
        return middle - spread, middle + spread


class Block:
    """Vectors of one length, by label, with their codes."""

    def __init__(self, row):
        self.dim = row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), -1)
        self.codes = np.frombuffer(row["codes"], "<u8").reshape(len(self.ids), -1)
        self.alignments, self.lengths = np.frombuffer(row["alignments"], "<f8"), np.frombuffer(row["lengths"], "<f8")

    def intervals(self, planes: Planes, some: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return planes.intervals(some, self.codes[lo:hi], self.alignments[lo:hi], self.lengths[lo:hi])


def coded_blocks(rows: DataFrame, scale: float, block_values: int) -> DataFrame:
    def build(dim, columns):
        order = np.argsort(columns["label"], kind="stable")
        x = quantize(columns["embedding"], scale)[order]
        codes, alignment, length = one_bit_codes(x)
        return {"dim": dim, "n": len(x), "ids": columns["vec_id"][order].astype("<i8").tobytes(),
                "labels": columns["label"][order].astype("<i8").tobytes(), "vectors": x.tobytes(), "codes": codes.astype("<u8").tobytes(),
                "alignments": alignment.tobytes(), "lengths": length.tobytes()}

    return pack(rows, _BLOCK, build, block_values, ("label",))


class Anchors(Block):
    """A packed block of anchors within a chunk; ``at``: the number of its first one there."""

    def __init__(self, row, at: int):
        super().__init__(row)
        self.at, self.planes = at, Planes(self.x)


def _steps(lo: int, hi: int, step: int) -> Iterator[tuple[int, int]]:
    return ((at, min(hi, at + step)) for at in range(lo, hi, step))


class PositiveSearch:
    """Running best rows of the anchors' own labels."""

    def __init__(self, anchors: Anchors, k: int):
        self.q, self.k, self.scored, self.met = anchors, k, 0, 0
        self.best = (np.zeros(0, np.int64),) * 3
        self.floor = np.full(len(anchors.ids), _LOWEST, np.int64)

    def meet(self, rows: Block) -> None:
        q = self.q
        for label in np.intersect1d(q.labels, rows.labels).tolist():
            first, last = np.searchsorted(q.labels, [label, label + 1])
            lo, hi = np.searchsorted(rows.labels, [label, label + 1]).tolist()
            for a, b in _steps(first, last, 512):
                for c, d in _steps(lo, hi, 1024):
                    some = np.arange(a, b)
                    _, upper = rows.intervals(q.planes, some, c, d)
                    may = (upper >= self.floor[some][:, None]) & (q.ids[some][:, None] != rows.ids[None, c:d])
                    self.met += may.size
                    self.add(rows, *np.nonzero(may), a, c)

    def add(self, rows: Block, a: np.ndarray, r: np.ndarray, first: int, lo: int) -> None:
        self.scored += len(a)
        key, r = a + first, r + lo
        score = pair_scores(self.q.x, rows.x, key, r)
        good = score >= self.floor[key]
        self.best = keep_best(*(np.concatenate([old, new[good]]) for old, new in zip(self.best, (key, score, rows.ids[r]))), self.k)
        self.floor = floors(self.best[0], self.best[1], self.k, self.floor)

    def found(self) -> tuple[np.ndarray, ...]:
        return self.best[0] + self.q.at, *self.best[1:]


class NegativeSearch:
    """Running best rows of other labels, per anchor and window ``percent * positive <= 100 * score <= 100 *
    positive``; ``windows``: positive scores per anchor, by rank, with a mask of those that are there."""

    def __init__(self, anchors: Anchors, scores: np.ndarray, there: np.ndarray, k: int, percent: int):
        self.q, self.k, self.width, self.scored, self.met = anchors, k, scores.shape[1], 0, 0
        self.there = there & (scores >= 0)
        self.top = scores
        self.low = np.array([[-(-percent * int(s) // 100) for s in row] for row in scores.tolist()], np.int64).reshape(scores.shape)
        self.floor = self.low.ravel().copy()
        self.best = (np.zeros(0, np.int64),) * 3

    def meet(self, rows: Block) -> None:
        q = self.q
        asking = np.flatnonzero(self.there.any(axis=1))
        for a, b in _steps(0, len(asking), 512):
            some = asking[a:b]
            for c, d in _steps(0, len(rows.ids), 1024):
                lower, upper = rows.intervals(q.planes, some, c, d)
                floor = self.floor.reshape(-1, self.width)
                may = np.zeros(lower.shape, bool)
                for j in range(self.width):
                    has = self.there[some, j][:, None]
                    may |= has & (upper >= floor[some, j][:, None]) & (lower <= self.top[some, j][:, None])
                may &= q.labels[some][:, None] != rows.labels[None, c:d]
                may &= q.ids[some][:, None] != rows.ids[None, c:d]
                self.met += may.size
                i, r = np.nonzero(may)
                self.add(rows, some[i], r + c)

    def add(self, rows: Block, a: np.ndarray, r: np.ndarray) -> None:
        self.scored += len(a)
        score = pair_scores(self.q.x, rows.x, a, r)
        new: list[tuple] = []
        for j in range(self.width):
            key = a * self.width + j
            good = self.there[a, j] & (score >= self.floor[key]) & (score <= self.top[a, j])
            new.append((key[good], score[good], rows.ids[r[good]]))
        self.best = keep_best(*(np.concatenate([old, *(n[c] for n in new)]) for c, old in enumerate(self.best)), self.k)
        self.floor = floors(self.best[0], self.best[1], self.k, self.floor)

    def found(self) -> tuple[np.ndarray, ...]:
        return self.best[0] + self.q.at * self.width, *self.best[1:]


def _chunk_anchors(packed: list) -> list[Anchors]:
    at, out = 0, []
    for row in packed:
        out.append(Anchors(row, at))
        at += row["n"]
    return out


def search(blocks: DataFrame, chunk: list, make) -> DataFrame:
    """``key``, ``vec_id`` and ``score`` that ``make(anchors)``'s searches find in each task's blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(chunk)

    def run(frames: Iterator[pd.DataFrame]):
        searches = [make(a) for a in _chunk_anchors(sent.value)]
        for frame in frames:
            for row in frame.to_dict("records"):
                block = Block(row)
                for s in searches:
                    if s.q.dim == block.dim:
                        s.meet(block)
        for s in searches:
            key, score, ids = s.found()
            if len(key):
                yield pd.DataFrame({"key": key, "vec_id": ids, "score": score})

    return blocks.mapInPandas(run, "key long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0,
                   block_values: int = 1 << 18, chunk_values: int = 1 << 22) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each
    of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels that
    score from ``percent`` % of the positive's score up to it. Both frames have ``vec_id``, ``embedding``
    and ``label``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    label = F.col("label").cast("long").alias("label")
    rows = usable(vectors.select("vec_id", "embedding", label).where("label IS NOT NULL"), "label")
    blocks = scratch.table(coded_blocks(rows, scale, block_values), "blocks")
    asked = usable(anchors.select("vec_id", "embedding", label).where("label IS NOT NULL"), "label")
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "embedding")).alias("a")).select("vec_id", "a.dim", "a.embedding", "a.label")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    out = None
    for number, chunk in enumerate(query_chunks(coded_blocks(asked, scale, block_values), scratch, "anchors", chunk_values)):
        ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in chunk])
        scores, there = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), bool)
        positive_ids = np.zeros((len(ids), positives), np.int64)
        for r in ranked(search(blocks, chunk, lambda a: PositiveSearch(a, positives)), positives).toLocalIterator():  # a few per anchor of the chunk
            at = r["key"], r["rank"] - 1
            scores[at], there[at], positive_ids[at] = r["score"], True, r["vec_id"]

        def windows(a: Anchors, scores=scores, there=there) -> NegativeSearch:
            own = slice(a.at, a.at + len(a.ids))
            return NegativeSearch(a, scores[own], there[own], negatives, percent)

        found = ranked(search(blocks, chunk, windows), negatives)
        a, p = np.nonzero(there)
        names = spark.createDataFrame(pd.DataFrame({
            "own": a * positives + p, "anchor_id": ids[a], "positive_id": positive_ids[a, p], "positive_score": scores[a, p]}),
            "own long, anchor_id long, positive_id long, positive_score long")
        part = found.join(F.broadcast(names), F.col("key") == F.col("own")).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = scratch.table(part, f"found-{number}", len(ids) * positives * negatives)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _RESULT)

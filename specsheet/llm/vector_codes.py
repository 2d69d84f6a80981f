"""Vector code compression: product codes whose codebooks are fitted by cover-tree Lloyd rounds.

Components become integers, ``floor(scale * x)``, and a vector is cut into ``parts`` equal parts. Each
task packs its rows into blocks of bounded size and builds, once, one cover tree per block and part:
a node's points lie within its radius of its centre, its children's radius is half of that (or
less), children's centres stand further apart than it, and the centre itself is the first child. The
points are stored in tree order, so every subtree is one range and its sum is a difference of two
cumulative sums. The blocks are written to the shared folder and all rounds read them again.

A round walks every tree from its root. If a node's centre is nearer to one entry than to any other
by more than two radii, the triangle inequality gives the whole subtree to that entry, and its
range sum and count are added in one step. Entries that no point of the subtree can be nearest to are
dropped on the way down; only nodes still open at a leaf are compared point by point, exactly and with
ties to the lower index. Tasks return one sum per codebook component, whatever their number of rows,
and the driver holds nothing but the codebooks.

Cases: a vector that is null, empty, holds a null or non-finite component (before or after scaling),
or cannot be cut into equal parts takes no part; vectors of different lengths have codebooks of their
own; fewer rows than entries give as many entries as rows; a null id comes last in the order of ids,
equal ids are ordered by their vectors, and repeated rows count each; an entry that no part is
nearest to stays; a squared distance beyond 64 bits raises; an empty table gives no rows; columns
that are not named in ``carry`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .scratch import Scratch

LEAF = 16  # points of a node that is not cut further
_TREE = ("order", "lo", "hi", "center", "child", "children")
_BLOCK = "dim int, n int, points binary, radius binary, " + ", ".join(f"{c} binary" for c in _TREE)
_SLACK = 1e-9  # of a distance, far above any rounding of its root


def number_type(top: int, width: int) -> type:
    """A type in which sums of ``width`` squared differences of integers up to ``top`` are exact."""
    most = width * (2 * top + 1) ** 2
    if most >= 1 << 63:
        raise OverflowError("a squared distance of these vectors does not fit 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


class CoverTree:
    """The cover trees of a block's parts; ``points`` are ``(parts * n, width)`` integers, part after part.
    Node arrays are in breadth-first order: the first ``parts`` nodes are the roots, and a node's children
    stand one after the other."""

    def __init__(self, points: np.ndarray, parts: int, **arrays: np.ndarray):
        self.points, self.parts, self.n = points, parts, len(points) // parts
        for name, value in arrays.items():
            setattr(self, name, value)

    @classmethod
    def build(cls, points: np.ndarray, parts: int) -> CoverTree:
        n = len(points) // parts
        far = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(axis=1).astype(np.float64))
        order = np.arange(parts * n)
        lo = np.arange(parts) * n
        levels = {"lo": [lo], "hi": [lo + n], "center": [lo.copy()], "radius": [], "child": [], "children": []}
        to_center = far(order, np.repeat(lo, n))  # of each position in ``order``
        total = parts
        while len(levels["lo"][-1]):
            lo, hi, center = (levels[c][-1] for c in ("lo", "hi", "center"))
            bounds = np.stack([lo, hi], axis=1).ravel()  # what lies between two nodes belongs to neither
            radius = np.maximum.reduceat(np.append(to_center, 0), bounds)[::2]
            levels["radius"].append(radius)
            cut = np.flatnonzero((hi - lo > LEAF) & (radius > 0))
            size = (hi - lo)[cut]
            owner = np.repeat(np.arange(len(cut)), size)  # of each point of the nodes to be cut
            at = np.repeat(lo[cut] - np.cumsum(size) + size, size) + np.arange(size.sum())
            member, distance = order[at], to_center[at].copy()
            reach = (radius[cut] / 2)[owner]
            heart = np.full(len(at), -1)  # centre of the child that covers the point
            heart[distance <= reach] = center[cut][owner[distance <= reach]]
            rank, open_points, turn = np.zeros(len(at), np.int64), np.flatnonzero(distance > reach), 0
            while len(open_points):
                turn += 1
                nodes, first = np.unique(owner[open_points], return_index=True)
                new = np.zeros(len(cut), np.int64)
                new[nodes] = member[open_points[first]]
                to_new = far(member[open_points], new[owner[open_points]])
                near = to_new <= reach[open_points]
                covered = open_points[near]
                heart[covered], distance[covered], rank[covered] = new[owner[covered]], to_new[near], turn
                open_points = open_points[~near]
            by_child = np.lexsort((rank, owner))
            order[at], to_center[at] = member[by_child], distance[by_child]
            owner, rank, heart = owner[by_child], rank[by_child], heart[by_child]
            begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1]))[: len(at)])
            children = np.zeros(len(lo), np.int64)
            children[cut] = np.bincount(owner[begin], minlength=len(cut))
            levels["children"].append(children)
            levels["child"].append(total + np.cumsum(children) - children)
            total += len(begin)
            ends = np.append(begin[1:], len(at))[: len(begin)]
            levels["lo"].append(at[begin])
            levels["hi"].append(at[ends - 1] + 1 if len(begin) else begin)
            levels["center"].append(heart[begin])
        for c in ("lo", "hi", "center"):
            levels[c].pop()
        return cls(points, parts, order=order, **{c: np.concatenate(v) for c, v in levels.items()})

    def cumulative(self) -> np.ndarray:
        """Sums of the points before each place in tree order."""
        sums = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points[self.order].astype(np.int64), axis=0, out=sums[1:])
        return sums

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(nodes, entries)`` of subtrees that go to one entry as a whole and ``(places, entries)`` of the
        points, by their place in tree order, that were compared one by one."""
        entries = books.shape[1]
        kind = number_type(int(max(np.abs(self.points).max(initial=0), np.abs(books).max(initial=0))), self.points.shape[1])
        points, books = self.points.astype(kind), books.astype(kind)
        done: tuple[list, ...] = ([], [], [], [])
        nodes, open_entries = np.arange(self.parts), np.ones((self.parts, entries), bool)
        while len(nodes):
            squared = self._squared(points, self.center[nodes], books)
            distance = np.where(open_entries, np.sqrt(squared.astype(np.float64)), np.inf)
            best = np.where(open_entries, squared, squared.max() + 1).argmin(axis=1)
            least = distance[np.arange(len(nodes)), best]
            reach = (least + 2 * self.radius[nodes]) * (1 + _SLACK)
            open_entries = distance <= reach[:, None]
            alone = (open_entries.sum(axis=1) == 1) | (self.radius[nodes] == 0)
            done[0].append(nodes[alone])
            done[1].append(best[alone])
            leaf = ~alone & (self.children[nodes] == 0)
            places, which = self._spread(self.lo[nodes[leaf]], self.hi[nodes[leaf]])
            for at in range(0, len(places), 1 << 14):
                some, of = places[at : at + (1 << 14)], which[at : at + (1 << 14)]
                squared = self._squared(points, self.order[some], books)
                done[2].append(some)
                done[3].append(np.where(open_entries[leaf][of], squared, squared.max() + 1).argmin(axis=1))
            down = ~alone & ~leaf
            first = self.child[nodes[down]]
            nodes, which = self._spread(first, first + self.children[nodes[down]])
            open_entries = open_entries[down][which]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in done)

    def _squared(self, points: np.ndarray, which: np.ndarray, books: np.ndarray) -> np.ndarray:
        """Squared distances of some points to all entries of their part's codebook."""
        out = np.empty((len(which), books.shape[1]), points.dtype)
        part = which // self.n
        for p in np.unique(part).tolist():
            rows = np.flatnonzero(part == p)
            x, c = points[which[rows]], books[p]
            for e in range(len(c)):
                out[rows, e] = ((x - c[e]) ** 2).sum(axis=1)
        return out

    @staticmethod
    def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of the ranges, and the range of each."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        return lo[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which], which

    def sums(self, books: np.ndarray) -> np.ndarray:
        """Per part and entry: the sum of its nearest points, and their number in the last column."""
        width = books.shape[2]
        out = np.zeros((self.parts * books.shape[1], width + 1), np.int64)
        before = self.cumulative()
        nodes, to, places, entry = self.nearest(books)
        lo, hi = self.lo[nodes], self.hi[nodes]
        cell = lo // self.n * books.shape[1] + to
        np.add.at(out, cell, np.concatenate([before[hi] - before[lo], (hi - lo)[:, None]], axis=1))
        cell = places // self.n * books.shape[1] + entry
        np.add.at(out, cell, np.concatenate([before[places + 1] - before[places], np.ones((len(places), 1), np.int64)], axis=1))
        return out.reshape(self.parts, books.shape[1], width + 1)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries ``(n, parts)`` of every row and its squared distance over all parts."""
        nodes, to, places, entry = self.nearest(books)
        code = np.empty(len(self.points), np.int64)
        at, which = self._spread(self.lo[nodes], self.hi[nodes])
        code[self.order[at]] = to[which]
        code[self.order[places]] = entry
        chosen = books[np.arange(len(code)) // self.n, code].astype(np.int64)
        squared = ((self.points.astype(np.int64) - chosen) ** 2).sum(axis=1).reshape(self.parts, self.n)
        total = squared.astype(np.float64).sum(axis=0)
        if len(total) and total.max() >= 2.0**62:
            raise OverflowError("a squared distance of these vectors does not fit 64 bits")
        return code.reshape(self.parts, self.n).T, squared.sum(axis=0)


def usable_vectors(vectors: DataFrame, parts: int, scale: float, carry: tuple[str, ...]) -> DataFrame:
    """``dim``, ``vec_id``, ``values`` (integers as doubles) and the carried columns of the rows that take part."""
    values = F.col("embedding").cast("array<double>")
    scaled = F.transform("own_values", lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("own_id"), values.alias("own_values"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows.where(~F.exists("own_values", lambda x: x.isNull())).select(
        F.size("own_values").alias("dim"), F.col("own_id").alias("vec_id"), scaled.alias("scaled"), *[f"carry_{c}" for c in carry])
    finite = ~F.exists("scaled", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.col("dim") > 0) & (F.col("dim") % parts == 0) & finite)
    return rows.withColumnRenamed("scaled", "values")


def tree_blocks(rows: DataFrame, parts: int, carry: tuple[str, ...], block_values: int) -> DataFrame:
    """Blocks of about ``block_values`` components with their cover trees."""
    kept = ["vec_id", *[f"carry_{c}" for c in carry]]
    schema = StructType([*StructType.fromDDL(_BLOCK).fields, *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in kept]])

    def block(table: pa.Table, dim: int) -> pa.RecordBatch:
        table = table.combine_chunks()
        values = np.floor(table["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        n, width = len(values), dim // parts
        number_type(int(np.abs(values).max(initial=0)), width)
        points = values.reshape(n, parts, width).transpose(1, 0, 2).reshape(parts * n, width).astype(np.int64)
        tree = CoverTree.build(points, parts)
        cells = [pa.array([dim], pa.int32()), pa.array([n], pa.int32()), pa.array([points.astype("<i8").tobytes()]),
                 pa.array([tree.radius.astype("<f8").tobytes()]), *[pa.array([getattr(tree, c).astype("<i4").tobytes()]) for c in _TREE]]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[c].combine_chunks()) for c in kept]
        return pa.RecordBatch.from_arrays([*cells, *lists], names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]):
        waiting: dict[int, list[pa.Table]] = {}
        held = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = table.filter(pa.array(dims == dim))
                step = max(1, block_values // dim)
                for at in range(0, len(own), step):
                    piece = own.slice(at, step)
                    if sum(len(t) for t in waiting.get(dim, [])) + len(piece) > step:
                        held -= dim * sum(len(t) for t in waiting[dim])
                        yield block(pa.concat_tables(waiting.pop(dim)), dim)
                    waiting.setdefault(dim, []).append(piece)
                    held += dim * len(piece)
            while held > 2 * block_values:  # many lengths: the fullest goes
                dim = max(waiting, key=lambda d: d * sum(len(t) for t in waiting[d]))
                held -= dim * sum(len(t) for t in waiting[dim])
                yield block(pa.concat_tables(waiting.pop(dim)), dim)
        for dim in sorted(waiting):
            yield block(pa.concat_tables(waiting[dim]), dim)

    return rows.mapInArrow(pack, schema)


def read_block(row, parts: int) -> CoverTree:
    points = np.frombuffer(row["points"], "<i8").reshape(parts * row["n"], -1)
    arrays = {c: np.frombuffer(row[c], "<i4").astype(np.int64) for c in _TREE}
    return CoverTree(points, parts, radius=np.frombuffer(row["radius"], "<f8"), **arrays)


def fit_codebooks(blocks: DataFrame, first: dict[int, np.ndarray], rounds: int) -> dict[int, np.ndarray]:
    """Codebooks ``(parts, entries, width)`` per vector length after ``rounds`` Lloyd rounds from ``first``."""
    books = {dim: b.copy() for dim, b in first.items()}
    columns = ["dim", "n", "points", "radius", *_TREE]
    for _ in range(rounds):
        now = books

        def sums(frames: Iterator[pd.DataFrame], now=now):
            total: dict[int, np.ndarray] = {}
            for frame in frames:
                for row in frame.to_dict("records"):
                    got = read_block(row, len(now[row["dim"]])).sums(now[row["dim"]])
                    total[row["dim"]] = total.get(row["dim"], 0) + got
            for dim, t in total.items():
                yield pd.DataFrame({"dim": dim, "cell": np.arange(t.size), "value": t.ravel()})

        found = blocks.select(*columns).mapInPandas(sums, "dim int, cell int, value long")
        rows = found.groupBy("dim", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # the codebooks' size
        books = {}
        for dim, book in now.items():
            total = np.zeros((*book.shape[:2], book.shape[2] + 1), object).ravel()
            for r in rows:
                if r["dim"] == dim:
                    total[r["cell"]] = int(r["value"])
            total = total.reshape(*book.shape[:2], -1)
            books[dim] = np.array([[[s // own[-1] for s in own[:-1]] if own[-1] else old.tolist() for own, old in zip(t, b)]
                                   for t, b in zip(total, book)], np.int64)
    return books


def encode_blocks(blocks: DataFrame, books: dict[int, np.ndarray], parts: int, carry: tuple[str, ...]) -> DataFrame:
    """Every row's carried columns, ``dim``, ``code`` (two hex digits a part; more where there are more than
    256 entries) and ``error`` (squared distance)."""
    kept = ["vec_id", *[f"carry_{c}" for c in carry]]
    fields = [StructField("dim", StructType.fromDDL("d int")["d"].dataType)]
    fields += [StructField(c, blocks.schema[c].dataType.elementType) for c in kept]
    schema = StructType([*fields, *StructType.fromDDL("code string, error long").fields])

    def encode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dim", "n", "points", "radius", *_TREE)}
                codes, error = read_block(row, parts).codes(books[row["dim"]])
                digits = max(2, -(-(books[row["dim"]].shape[1] - 1).bit_length() // 4))
                text = [format(c, f"0{digits}x") for c in range(books[row["dim"]].shape[1])]
                for at in range(0, row["n"], 10_000):
                    code = ["".join(text[c] for c in r) for r in codes[at : at + 10_000].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), row["dim"], np.int32)), *[batch.column(c)[i].values.slice(at, 10_000) for c in kept],
                         pa.array(code, pa.string()), pa.array(error[at : at + 10_000])], names=schema.names)

    return blocks.mapInArrow(encode, schema)


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0,
                     carry: tuple[str, ...] = (), block_values: int = 1 << 20) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(codes, codebooks)``: one row per vector with ``dim``, ``vec_id``, the ``carry`` columns, ``code`` and
    ``error``; and per vector length its integer codebooks ``(parts, entries, length / parts)``."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    rows = usable_vectors(vectors, parts, scale, carry)
    blocks = scratch.table(tree_blocks(rows, parts, carry, block_values), "blocks")
    by_id = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "values")  # limited in each task before the shuffle
    least = rows.select("dim", "vec_id", "values").withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= entries)
    first: dict[int, list] = {}
    for r in sorted(least.select("dim", "place", "values").collect(), key=lambda r: (r["dim"], r["place"])):
        first.setdefault(r["dim"], []).append(np.floor(np.array(r["values"])).astype(np.int64))
    start = {dim: np.array(v).reshape(len(v), parts, -1).transpose(1, 0, 2) for dim, v in first.items()}
    books = fit_codebooks(blocks, start, rounds)
    codes = encode_blocks(blocks, books, parts, carry)
    return codes.select("dim", "vec_id", *[F.col(f"carry_{c}").alias(c) for c in carry], "code", "error"), books


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()

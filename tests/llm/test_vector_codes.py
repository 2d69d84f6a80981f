"""Vector codes against plain Lloyd rounds that compare every part with every entry."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsheet.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6, scale=4096.0):
    """``rows``: (vec_id, label, list of finite floats) of one length, in the order of ids."""
    ints = [[int(np.floor(scale * x)) for x in v] for _, _, v in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(z) // len(z) for z in zip(*o)] if o else old for o, old in zip(own, books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found)], digest


def data(kind, n=400, dim=32):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        v = np.repeat(rng.normal(size=(20, dim)), n // 20, axis=0) + rng.normal(size=(n, dim)) * 0.02
    elif kind == "ties":
        v = rng.integers(-2, 3, size=(n, dim)).astype(float)
    elif kind == "large":
        v = rng.normal(size=(n, dim)) * 1e4
    elif kind == "copies":
        v = np.repeat(rng.normal(size=(4, dim)), n // 4, axis=0)
    else:
        v = rng.normal(size=(n, dim))
    return [(i, i % 3 or None, x.tolist()) for i, x in enumerate(v)]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large", "copies"])
def test_codes(spark, kind):
    rows = data(kind)
    codes, books = V.compress_vectors(frame(spark, rows), carry=("label",), block_values=2000)
    expected, digest = brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == expected
    assert V.codebook_digest(books[32]) == digest
    assert {r.vec_id: r.label for r in codes.collect()} == {i: label for i, label, _ in rows}


def test_cover_tree_shape():
    """Children cover their parent's points within half its radius, and sums of ranges are right."""
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, size=(4 * 500, 3))
    points[:30] = points[0]
    t = V.CoverTree.build(points, 4)
    assert sorted(t.order.tolist()) == list(range(2000)) and len(t.lo) > 8
    gap = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(axis=-1))
    for k in range(len(t.lo)):
        members = t.order[t.lo[k] : t.hi[k]]
        assert np.isclose(gap(members, t.center[k]).max(), t.radius[k])
        assert t.center[k] in members and len(set(members // 500)) == 1
        if t.children[k]:
            child = np.arange(t.child[k], t.child[k] + t.children[k])
            assert t.lo[child[0]] == t.lo[k] and t.hi[child[-1]] == t.hi[k] and (t.lo[child[1:]] == t.hi[child[:-1]]).all()
            assert (t.radius[child] <= t.radius[k] / 2).all() and t.center[k] == t.center[child[0]]
            hearts = t.center[child]
            apart = gap(hearts[:, None], hearts[None]) + 1e9 * np.eye(len(child))
            assert apart.min() > t.radius[k] / 2
    books = rng.integers(-1000, 1000, size=(4, 16, 3))
    nodes, _, places, _ = t.nearest(books)
    assert (t.hi[nodes] - t.lo[nodes]).sum() + len(places) == 2000 and len(places) < 2000
    assert t.sums(books)[:, :, -1].sum() == 2000


def test_awkward_rows(spark):
    rows = data("random", 30, 8)
    odd = [(100, 1, None), (101, 1, []), (102, 1, [1.0] * 7), (103, 1, [None] * 8), (104, 1, [float("nan")] * 8), (105, 1, [float("inf")] * 8),
           (200, None, [0.5] * 16), (201, 2, [0.25] * 16), (3, 9, rows[3][2]), (None, None, rows[4][2])]
    codes, books = V.compress_vectors(frame(spark, rows + odd).withColumns({c: F.lit(1) for c in ("dim", "n", "points", "code", "error", "place", "values")}))
    got = sorted(((r.vec_id, r.code, r.error) for r in codes.where("dim = 8").collect()), key=str)
    taking = sorted([*rows, odd[8]], key=lambda r: (r[0], r[2])) + [odd[9]]
    expected, digest = brute(taking)
    assert got == sorted(expected, key=str) and V.codebook_digest(books[8]) == digest
    assert {r.vec_id for r in codes.where("dim = 16").collect()} == {200, 201} and books[16].shape == (8, 2, 2)
    none, empty = V.compress_vectors(frame(spark, []))
    assert none.count() == 0 and empty == {}


def test_values_beyond_64_bits_raise():
    with pytest.raises(OverflowError):
        V.number_type(1 << 32, 8)
    assert V.number_type(1000, 8) is np.float64 and V.number_type(1 << 28, 8) is np.int64

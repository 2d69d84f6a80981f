"""Hard negatives against brute force, and the interval against exact products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specsheet.llm import hard_negatives as H
from specsheet.llm import topk
from specsheet.llm.vector_search import keep_best


def brute(rows, is_anchor, positives=5, negatives=5, percent=80, scale=256.0):
    """``rows``: (id, label, vector), all whole and of one length, ids distinct."""
    ints = {i: [int(np.floor(scale * x)) for x in v] for i, _, v in rows}
    labels = {i: label for i, label, _ in rows}
    out = []
    for a in (i for i in ints if is_anchor(i)):
        ranked = sorted((-sum(x * y for x, y in zip(ints[a], ints[i])), i) for i in ints if i != a)
        same = [(p, -s) for s, p in ranked if labels[p] == labels[a]][:positives]
        for p, ps in same:
            fit = [(n, -s) for s, n in ranked if labels[n] != labels[a] and percent * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, ns) in enumerate(fit)]
    return sorted(out)


def data(kind, n=240, dim=12):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        v = np.repeat(rng.normal(size=(12, dim)), n // 12, axis=0) + rng.normal(size=(n, dim)) * 0.15
    elif kind == "ties":
        v = rng.integers(0, 2, size=(n, dim)).astype(float)
    elif kind == "large":
        v = rng.normal(size=(n, dim)) * 1e5
    else:
        v = rng.normal(size=(n, dim)) + 0.8
    labels = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 6, n))  # a label in a third of all rows
    return [(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(labels, v))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large"])
def test_hard_negatives(spark, kind):
    rows = data(kind)
    vectors = frame(spark, rows)
    got = H.hard_negatives(vectors, vectors.where("vec_id % 10 = 0"), block_values=700, chunk_values=120).collect()
    expected = brute(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == expected and expected


def test_awkward_rows(spark):
    rows = [(i, c, v) for i, c, v in data("random", 60)]
    odd = [(None, 1, [1.0] * 12), (70, None, [1.0] * 12), (80, 1, None), (90, 1, []), (100, 1, [None] * 12), (110, 1, [float("nan")] * 12),
           (120, 1, [float("-inf")] * 12), (130, 1, [2.0, 3.0]), (131, 2, [2.0, 3.0]), (132, 1, [2.0, 3.0]), rows[5], rows[10], rows[10]]
    vectors = frame(spark, rows + odd).withColumns({c: F.lit(1) for c in ("key", "own", "rank", "dim", "ids", "n", "anchor_id", "a")})
    got = sorted(map(tuple, H.hard_negatives(vectors, vectors.where("vec_id % 10 = 0")).collect()))
    short = [(130, 132, 1, 131, 13 << 16, 13 << 16)]
    assert got == sorted(brute(rows, lambda i: i % 10 == 0) + short)
    assert H.hard_negatives(frame(spark, []), frame(spark, [])).count() == 0
    assert H.hard_negatives(vectors, frame(spark, [])).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_and_discard(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(size=(400, dim)) * 256)
    x[0], x[1], x[2] = 0, 5, x[3]
    q = np.concatenate([x[:6], np.floor(rng.normal(size=(20, dim)) * 1000), np.zeros((1, dim))])
    rotated = H.rotate(x)
    assert np.allclose((rotated**2).sum(1), (x**2).sum(1)) and np.allclose(rotated @ H.rotate(q).T, x @ q.T)
    lower, upper = H.Planes(q).intervals(np.arange(len(q)), *H.one_bit_codes(x))
    exact = q @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    length = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
    assert ((upper - lower) <= 1.5 * length + 1).mean() > 0.95  # without codes it would be twice the lengths' product


def test_searches_drop_most_candidates_of_clusters():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(10, 64)), 60, axis=0) + rng.normal(size=(600, 64)) * 0.1
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    codes, alignment, length = H.one_bit_codes(x)
    row = {"dim": 64, "n": 600, "ids": np.arange(600).tobytes(), "labels": (np.arange(600) // 300).tobytes(), "vectors": x.tobytes(),
           "codes": codes.tobytes(), "alignments": alignment.tobytes(), "lengths": length.tobytes()}
    search = H.NegativeSearch(H.Anchors(row, 0), np.full((600, 2), 60_000), np.ones((600, 2), bool), 5, 80)
    search.meet(H.Block(row))
    assert search.met == 360_000 and search.scored < 0.5 * search.met


def test_topk_drops_candidates_and_orders_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(20, 16)) * 3, 40, axis=0) + rng.normal(size=(800, 16)) * 0.1
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (20, x[20].tolist())], "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=4, block_values=640).collect()
    ints = np.floor(64 * x).astype(int)
    for q in range(0, 800, 20):
        expected = sorted((-int(ints[q] @ ints[i]), i) for i in range(800) if i != q)[:4]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(expected)]
    pivots = topk.spread_pivots(ints.astype(float), 20)
    near = topk.distances(ints.astype(float), pivots)
    pack = lambda at: {"dim": 16, "n": len(at), "ids": at.tobytes(), "vectors": ints[at].astype(float).tobytes(), "distances": near[at].T.astype("<f4").tobytes()}
    q, rows = topk.Block(pack(np.arange(0, 800, 20))), topk.Block(pack(np.arange(800)))
    _, _, evaluated = topk.search_block(q, rows, np.arange(40), (np.zeros(0, np.int64),) * 3, np.full(40, -(1 << 62)), 4)
    assert evaluated < 0.5 * 40 * 800


def test_keep_best():
    key, score, ids = keep_best(np.array([1, 0, 1, 1, 1, 0]), np.array([5, 2, 9, 5, 5, 2]), np.array([4, 1, 2, 3, 3, 1]), 2)
    assert list(zip(key.tolist(), score.tolist(), ids.tolist())) == [(0, 2, 1), (1, 9, 2), (1, 5, 3)]

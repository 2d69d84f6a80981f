"""Jaccard join against brute force: near-copy groups, shared lines, frequent tokens, small blocks."""

import random

import pytest
from llm_fixtures import AWKWARD, brute_components, documents

from specsheet.llm import jaccard_join as J


def group_texts(seed: int) -> list[str]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    lines = [" ".join(word() for _ in range(12)) for _ in range(3)]
    texts = []
    for size, copies, edits in ((150, 90, 9), (40, 40, 3), (9, 25, 1), (700, 25, 40), (3, 10, 1), (18, 30, 2)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[word()], [], [w[at], word()]])
            texts.append(" ".join(w))
    for _ in range(60):
        texts.append(" ".join([rnd.choice(lines), *(word() for _ in range(rnd.randint(5, 60))), rnd.choice(lines)]))
    texts += rnd.sample(texts, 40)
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,frequent,block", [(1, 3, 8), (2, 40, 256), (3, 0, 5)])
def test_groups(spark, seed, frequent, block):
    texts = group_texts(seed)
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_documents(docs, frequent=frequent, block=block).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_awkward_rows(spark):
    rows = list(enumerate(AWKWARD))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_documents(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_null_and_repeated_ids_and_empty(spark):
    docs = documents(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, "x y")])
    got = sorted(tuple(r) for r in J.link_documents(docs).collect() if r.doc_id is not None)
    assert got == [(2, 1, 2), (5, 2, 5), (5, 2, 5)]
    assert [tuple(r) for r in J.link_documents(docs).where("doc_id is null").collect()] == [(None, 2, None)]
    assert J.link_documents(documents(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = group_texts(4)
    docs = documents(spark, list(enumerate(texts)))
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {c for _, c in brute_components(list(enumerate(texts))).values()}
    assert {r.doc_id for r in kept.collect()} == expected


def test_prefix_length_counts_subclasses():
    import numpy as np

    tokens = np.sort(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    rare = np.zeros(300, bool)
    assert J.prefix_length(tokens, rare, 30, 3) == 31
    often = ~rare
    groups = len(np.unique(J.subclass(tokens[: J.prefix_length(tokens, often, 30, 3)], 3)))
    assert J.prefix_length(tokens, often, 30, 3) == 31 + groups


@pytest.mark.parametrize("size", [300, 3000, 9000, 40000])
def test_bitmaps_part_sets_of_nothing_in_common(size):
    """However many tokens: sets that share none differ in more bits than linked ones may."""
    import numpy as np

    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(6)]
    near = np.union1d(sets[0][size // 20 :], rng.integers(0, 2**63, size // 20, dtype=np.uint64))
    maps = J.Bitmaps([J.bitmap(t) for t in [*sets, near]])
    n = np.array([len(t) for t in [*sets, near]])
    a, b = np.triu_indices(7, 1)
    good, _ = maps.within(a, b, n[a] + n[b] - 2 * -(-80 * (n[a] + n[b]) // 180))
    assert [(int(x), int(y)) for x, y in zip(a[good], b[good])] == [(0, 6)]


def test_units_and_texts_are_dealt_out_in_turns(spark, monkeypatch):
    """An entry of many blocks repeats its classes, and pairs their texts; no turn shuffles more than its share."""
    texts = group_texts(5)
    docs, rows, pairs = documents(spark, list(enumerate(texts))), [], []
    find, verify = J.possible_pairs, J.verified
    monkeypatch.setattr(J, "UNIT_ROWS", 500)
    monkeypatch.setattr(J, "TEXT_PAIRS", 40)
    monkeypatch.setattr(J, "possible_pairs", lambda units, *rest: rows.append(units.count()) or find(units, *rest))
    monkeypatch.setattr(J, "verified", lambda some, *rest: pairs.append(some.count()) or verify(some, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_documents(docs, frequent=3, block=5, turn_rows=3, turn_pairs=0.1).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert max(rows) < 2 * 3 * len(texts) < sum(rows)  # a unit stays whole, so a share is met nearly
    assert max(pairs) < 2 * 40 < sum(pairs)

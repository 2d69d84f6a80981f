"""SimHash near-dedup against brute force: fingerprints bit by bit, components by comparing all pairs."""

import random

import numpy as np
import pytest
import xxhash
from llm_fixtures import AWKWARD, LOWER, WHITE_WORDS, documents
from pyspark.sql import functions as F

from specsheet.llm import simhash
from specsheet.llm.scratch import Scratch


def brute_fingerprint(text, n=3):
    words = WHITE_WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=2):
    """Component number per fingerprint."""
    prints, root = sorted(set(prints)), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def expected(rows, distance=2):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    groups, least = brute_groups([p for _, p in prints], distance), {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    return sorted(((i, f"{p:016x}", least.get(groups[p])) for i, p in prints), key=str)


def copies(seed):
    rnd, texts = random.Random(seed), []
    for size in (30, 120, 500, 1500):
        base = [f"w{rnd.randrange(900)}" for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(size)] = f"e{rnd.randrange(900)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("limit,blocks", [(512, 4), (1, 3), (2, 5)])
def test_groups(spark, limit, blocks):
    rows = list(enumerate([*AWKWARD, *copies(1), *copies(1)[:9]])) + [(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")]
    got = simhash.simhash_groups(documents(spark, rows), limit=limit, blocks=blocks).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("distance,blocks,limit", [(2, 4, 512), (2, 4, 3), (1, 3, 2), (3, 5, 2), (2, 3, 0)])
def test_links_of_crowded_keys(spark, distance, blocks, limit):
    """Chains of close fingerprints and many that share whole blocks."""
    rnd = random.Random(distance)
    prints = set()
    for _ in range(6):
        p = rnd.getrandbits(64)
        for _ in range(40):
            for _ in range(rnd.choice([1, 1, 2, 2, 3, 6])):
                p ^= 1 << rnd.choice([0, 1, 5, 17, 18, 33, 40, 62, 63])
            prints.add(p)
    prints |= {rnd.getrandbits(16) for _ in range(300)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(classes, Scratch(spark, "test-simhash"), distance, blocks, limit).collect()
    groups = brute_groups(prints, distance)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((r.a % 2**64, r.b % 2**64) for r in links):
        assert (a ^ b).bit_count() <= distance and groups[a] == groups[b]
        root[find(a)] = find(b)
    assert len({find(p) for p in prints}) == len(set(groups.values()))


def test_one_text_in_a_third_of_all_rows_and_clashing_columns(spark):
    rows = [(i, "one copied text of a few words" if i % 3 == 0 else f"text {i} of its own {i * i}") for i in range(300)]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("fp", "least", "root", "node", "own", "mask", "part", "a", "b", "members")})
    got = simhash.simhash_groups(docs).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_and_long(spark):
    assert simhash.simhash_groups(documents(spark, [])).count() == 0
    long = "word another third " * 40_000
    assert simhash.simhash_groups(documents(spark, [(1, long)])).first().fingerprint == f"{brute_fingerprint(long):016x}"
    with pytest.raises(ValueError):
        simhash.block_masks(2, 2)

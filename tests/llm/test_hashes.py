"""Words and runs that collide under any polynomial modulo 2^64 with an odd base: no operator may mix them up."""

import zlib

import numpy as np
import pyarrow as pa
from llm_fixtures import AWKWARD, documents

from specsheet.llm import jaccard_join, packing, substring_dedup, token_files, words
from specsheet.llm.queries import default_tokenizer

TOKENIZER = default_tokenizer()
BITS = [bin(i).count("1") % 2 for i in range(2048)]
ONE = "".join("ab"[b] for b in BITS)
TWO = "".join("ba"[b] for b in BITS)
REST = [f"w{i}" for i in range(34)]
ROWS = [(i, " ".join([*REST[:17], w, *REST[17:]])) for i, w in ((1, ONE), (2, TWO))]


def test_such_words_have_one_polynomial():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    same = words.feature_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert same[0] == same[1]
    one, two = words.word_hashes([ONE.encode(), TWO.encode()])
    assert one[0] != one[1] and two[0] != two[1]


def test_runs_of_two_words():
    hashes = np.array([0x1234567, 0xABCDEF01], np.uint64)
    a, b = (words.Runs(hashes[np.array(BITS) ^ x]).hashes(np.array([0]), np.array([2048])) for x in (0, 1))
    assert a[0] != b[0]


def test_runs_are_equal_where_words_are():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 400)
    runs = words.Runs(rng.integers(0, 2**63, 3, dtype=np.uint64)[text])
    starts = rng.integers(0, 390, 4000)
    ends = np.minimum(starts + rng.integers(1, 60, 4000), 400)
    found = {}
    for s, e, h in zip(starts.tolist(), ends.tolist(), runs.hashes(starts, ends).tolist()):
        assert found.setdefault(h, tuple(text[s:e])) == tuple(text[s:e])
    assert len(found) == len(set(found.values()))


def test_hashed_texts_cut_at_texts():
    texts = [*AWKWARD, "ab", "cd", "ab cd", "AB"]
    got = list(words.hashed_texts(pa.array(texts), lower=True, block=40))
    assert len(got) == len(texts)
    known = {}
    for t, h in zip(texts, got):
        own = (t or "").encode().lower().split()
        assert [bytes(h.data[s:e]) for s, e in zip(h.starts, h.ends)] == own
        for w, x, y in zip(own, h.one.tolist(), h.two.tolist()):
            assert known.setdefault(w, (x, y)) == (x, y)
    assert len(set(known.values())) == len(known)


def test_substring_dedup_keeps_both(spark):
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(documents(spark, ROWS)).collect()}
    assert got == {1: 0, 2: 0}
    twice = [*ROWS, (3, ROWS[0][1])]
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(documents(spark, twice)).collect()} == {1: 35, 2: 0, 3: 35}


def test_jaccard_join_links_neither(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(documents(spark, ROWS)).collect()}
    assert got == {1: (33, 1), 2: (33, 2)}


def test_tokens_are_those_of_each_text(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, text in ROWS:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        row = token_files.token_offsets(documents(spark, ROWS), TOKENIZER).where(f"doc_id = {i}").first()
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        pieces = packing.pack_documents(documents(spark, ROWS), TOKENIZER, 1024).where(f"doc_id = {i}").orderBy("start").collect()
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]


def test_ids_with_two_texts_keep_their_links(spark):
    """Classes are not named by their ids: an id on two texts mixes neither links nor verification."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " end"), (7, b + " end"), (8, c)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(documents(spark, rows)).collect())
    assert got == [(5, 58, 5), (5, 58, 5), (6, 59, 5), (7, 59, 5), (8, 58, 8)]


def test_a_batch_of_near_copies_in_bounded_memory():
    """Ten units of a thousand near copies each: five million pairs, never held at once."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (10, 120), dtype=np.uint64)
    rows = []
    for u in range(10):
        for k in range(1000):
            tokens = base[u].copy()
            tokens[rng.integers(0, 120, 3)] = rng.integers(0, 2**63, 3, dtype=np.uint64)
            rows.append((u, 0, 0, 0, u * 1000 + k, 120, jaccard_join.bitmap(np.unique(tokens)), u * 1000 + k))
    frame = pd.DataFrame(rows, columns=["unit", "i", "j", "block", "id", "n", "bits", "root"])
    tracemalloc.start()
    found = pd.concat(list(jaccard_join.unit_pairs(frame, 80, every=False)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = found[found["unit"].isna()]
    assert len(pairs) == 10 * 999 and sorted(found["unit"].dropna()) == list(range(10))
    assert peak < 150e6

"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
from llm_fixtures import documents, shingle_set
from test_jaccard_join import group_texts


def brute_stage(rows, n, percent):
    """Smallest ids of the components by comparing all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {find(i) for i in ids}


def looser_copies(seed: int) -> list[str]:
    """Copies with 2 % scattered word edits, and with a fifth appended or a sixth cut off."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(20):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((50, 200, 600)))]
        edited = list(base)
        for at in rnd.sample(range(len(base)), len(base) // 50):
            edited[at] = f"e{rnd.randrange(4000)}"
        longer = base + [f"a{rnd.randrange(4000)}" for _ in range(len(base) // 5)]
        texts += [" ".join(w) for w in (base, edited, longer, base[: len(base) * 5 // 6])]
    return texts


def test_stage_rows_at_five_words(spark):
    rows = list(enumerate(group_texts(4) + looser_copies(5)))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), "").collect()}
    expected = brute_stage(rows, 5, 80)
    assert kept == expected
    assert len(expected) < len(brute_stage(rows, 3, 90))


def test_repeated_rows_and_null_ids(spark):
    near = " ".join(f"n{k}" for k in range(60))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "p q r s t u"), (7, "p q r s t u"),
            (None, "a b c d e f"), (None, "only here without an id"), (None, "only here without an id"), (None, "only  HERE without an id"),
            (None, near), (9, near + " end"), (8, "one text of the id"), (8, "another text of it"), (2, "another text of it"), (4, ""), (4, ""), (3, " "),
            (None, None), (None, None), (None, "")]
    docs = documents(spark, rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [t for i, t in got if i is None and t and t.startswith("only")]
    assert len(one) == 1
    expected = [(5, "a b c d e f"), (7, "p q r s t u"), (None, one[0]), (9, near + " end"), (8, "one text of the id"),
                (2, "another text of it"), (4, ""), (3, " "), (None, None), (None, None), (None, "")]
    assert got == sorted(expected, key=str)
    assert corpus_pipeline.near_duplicate_stage(spark, documents(spark, []), "").count() == 0

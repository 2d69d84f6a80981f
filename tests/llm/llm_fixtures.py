"""Small frames and brute-force helpers of the corpus tests."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts that operators must take without failing.
AWKWARD = [
    None, "", " ", "\n\t ", "a", "A b", "É é é", "word " * 4000, "x" * 30000, "a\x00b \x1f c", "日本 語 テキスト",
    "same text here", "same text here", "tab\tand\vfeed\fline\r\n end ", "😀 😀 😀 😀", "a b a b a b a b", "…" * 50,
]


def documents(spark, rows):
    """Documents of ``(doc_id, text)`` pairs."""
    full = [(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def shingle_set(text, n=3):
    words = WHITE_WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(rows, percent=90):
    """``doc_id -> (set size, component)`` by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
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
    return {i: (len(s), find(i)) for i, s in sets.items()}

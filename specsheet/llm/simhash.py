"""SimHash near-dedup: pigeonhole blocks of 64-bit fingerprints, then Hamming distance.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Texts of one
fingerprint are one class and take part once. The 64 bits are cut into ``blocks`` blocks; two
fingerprints that differ in ``distance`` bits or fewer agree on ``blocks - distance`` whole blocks at
least, so every choice of so many blocks is one key of an equi-join, and linked classes meet under a
key. The classes of a key are compared in one task, and a spanning forest of its links is handed on,
never its pairs.

A key that more than ``limit`` classes share is not compared in one task. Two of its classes link only
if flipping half of ``distance`` bits of one and of the other (outside the key) leads to a common
point, so these classes meet under points instead: a point has few possible neighbours, whatever the
size of the key. Nothing is dropped, and work grows with the number of classes.

Cases: a null, empty or wordless text has fingerprint zero, linked like any other; a text of fewer than
``n`` words is one shingle; repeated rows and equal ids share their fingerprint's component; a null id
is never a component's name (a component of null ids alone has none); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import text_bytes

SEED = 42
_STEP = 1 << 15  # shingles counted at a time


def fingerprint(text: bytes, n: int) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and the separators are space and \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(n, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), _STEP):
        some = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            raw = memoryview(data)
            found = [fingerprint(bytes(raw[a:b]), n) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of blocks on which two close fingerprints can agree, as signed longs."""
    if not distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(some) for some in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints that differ in ``distance`` bits or fewer."""
    bits = values.view(np.uint64)  # of signed integers numpy counts the bits of the absolute value
    waiting, a, b = np.arange(1, len(values)), [], []
    front = [0]
    while len(waiting) or front:
        if not front:
            front, waiting = [int(waiting[0])], waiting[1:]
        at = front.pop()
        near = np.bitwise_count(bits[waiting] ^ bits[at]) <= distance
        reached = waiting[near]
        a += [at] * len(reached)
        b += reached.tolist()
        front += reached.tolist()
        waiting = waiting[~near]
    return values[np.array(a, np.int64)], values[np.array(b, np.int64)]


def group_links(groups: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links between the classes of each row's ``members``, a spanning forest of them."""

    def link(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            found = [forest(values[a:b], distance) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(none + [f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return groups.select("members").mapInArrow(link, "a long, b long")


def flips(value, mask, distance: int):
    """``value`` with up to half of ``distance`` (rounded up) of the bits outside ``mask`` flipped."""
    points = F.array(value)
    bits = F.array(*[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    single = F.filter(bits, lambda bit: bit.bitwiseAND(mask) == 0)
    for _ in range((distance + 1) // 2):
        points = F.array_distinct(F.concat(points, F.flatten(F.transform(
            points, lambda p: F.transform(single, lambda bit: p.bitwiseXOR(bit))))))
    return points


def fingerprint_links(classes: DataFrame, scratch: Scratch, distance: int, blocks: int, limit: int) -> DataFrame:
    """``a, b``: links from which the components of the distinct ``fp`` follow."""
    masks = block_masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for m in masks])
    keyed = classes.select("fp", F.inline(keys))
    most = classes.count() * len(masks) // (limit + 1)
    large = scratch.table(keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).drop("n"), "large", most)
    usual = keyed.join(large, ["mask", "part"], "left_anti").groupBy("mask", "part").agg(F.collect_list("fp").alias("members"))
    at_points = keyed.join(large, ["mask", "part"]).select("fp", "mask", F.explode(flips(F.col("fp"), F.col("mask"), distance)).alias("point"))
    points = at_points.groupBy("mask", "point").agg(F.collect_list("fp").alias("members"))  # few per point
    several = F.size("members") > 1
    return group_links(usual.where(several).select("members").unionByName(points.where(several).select("members")), distance)


def simhash_groups(docs: DataFrame, n: int = 3, distance: int = 2, blocks: int = 4, limit: int = 512) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id that it reaches by links of ``distance`` differing bits or fewer."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, n), "rows")
    size = rows.count()  # from the written files' footers
    classes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", size)
    links = scratch.table(fingerprint_links(classes, scratch, distance, blocks, limit).distinct(), "links", size * len(block_masks(blocks, distance)))
    roots = components(links, scratch, "roots")
    rooted = scratch.table(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted", size)
    names = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    named = scratch.table(rooted.join(names, F.col("root") == F.col("of")).select(F.col("fp").alias("own"), "component_id"), "named", size)
    scratch.drop("classes", "links", "rooted", "large")
    joined = rows.join(named, F.col("fp") == F.col("own"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Substring dedup: seed with winnowed anchors, extend, and remove repeats of ``min_words`` or more.

Seed: of every window of ``min_words`` words the anchor is its word k-gram of least hash (the leftmost
of equals), so equal windows have the same anchor at the same place. The windows of one anchor
occurrence are a run; the words they span are its segment. Anchors that occur once end here, after
one count that is combined before the shuffle.

Extend: where all segments of an anchor are equal, every window of it is repeated and nothing more
is read. Where they differ, one text per distinct segment is read again and each of its windows is
compared to the others of that anchor, on either side of the anchor; the outcome is a bit mask per
distinct segment, so copies cost one mask, not a comparison each, and no pairs are formed. A
document's masks merge into maximal repeated spans.

Keys are 128 bits: the anchor's hash, and a segment's or window's from a second, independent hash of the
words (SipHash under two keys), so words that collide in one differ in the other. Anchors that many rows share are combined
before shuffles where they are counted, and join against one row per anchor or segment, whose other
side the engine splits.

Cases: a null or short text has no windows and keeps its words; ties and repeated rows are
repeats of each other; null and repeated ids are told apart by their texts; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import HashedText, Runs, hashed_texts, mix, text_bytes

_PLACE_BITS = np.uint64(30)  # an anchor's place within its text; the rest orders by hash
STEP = 64  # a run's first window and its number of windows share one integer

_ANCHORS = "doc_id long, text_hash long, run long, anchor long, segment long"
_WINDOWS = "anchor long, segment long, bit int, window long, copies long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


def gram_words(min_words: int) -> int:
    """Words of an anchor: at most 63 windows share one, and it is never longer than a window."""
    return max(min(8, min_words), min_words - STEP + 2)


class Text:
    """Words of a text and hashes of their runs."""

    def __init__(self, text: HashedText):
        self.n, self.one, self.two = len(text.one), Runs(text.one), Runs(text.two)

    def __len__(self) -> int:
        return self.n

    def runs(self, min_words: int) -> tuple[np.ndarray, ...]:
        """Per anchor occurrence: its first window, number of windows, anchor and segment hash."""
        k, n = gram_words(min_words), len(self)
        windows = n - min_words + 1
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        at = np.arange(n - k + 1)
        grams = self.one.hashes(at, at + k)
        least = (mix(grams) >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        width, span = min_words - k + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(first, windows))
        anchor_at = place[first]
        segment = self.two.hashes(first, first + count - 1 + min_words)
        return first, count, grams[anchor_at], mix(segment + (anchor_at - first).astype(np.uint64))

    def window_hashes(self, first: int, count: int, min_words: int) -> np.ndarray:
        at = np.arange(first, first + count)
        return self.two.hashes(at, at + min_words)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _texts(column):
    data, bounds = text_bytes(column)
    return (data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def find_anchors(rows: DataFrame, min_words: int) -> DataFrame:
    def seed(batches):
        for batch in batches:
            found = [Text(t).runs(min_words) for t in hashed_texts(batch.column(2))]
            each = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            first, count, anchor, segment = (np.concatenate([f[i] for f in found]) for i in range(4)) if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), batch.column(1).take(pa.array(each)),
                 pa.array(first * STEP + count), _signed(anchor), _signed(segment)], names=names)

    names = [c.split()[0] for c in _ANCHORS.split(", ")]
    return rows.mapInArrow(seed, _ANCHORS)


def extend(texts: DataFrame, min_words: int) -> DataFrame:
    """All windows of the segments that ``runs`` names in each text."""

    def windows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for hashed, runs in zip(hashed_texts(batch.column(0)), batch.column(1).to_pylist()):
                text = Text(hashed)
                for r in runs:
                    first, count = divmod(r["run"], STEP)
                    out[0].append(np.full(count, r["anchor"], np.int64))
                    out[1].append(np.full(count, r["segment"], np.int64))
                    out[2].append(np.arange(count, dtype=np.int32))
                    out[3].append(text.window_hashes(first, count, min_words).view(np.int64))
                    out[4].append(np.full(count, r["copies"], np.int64))
            types = [np.int64, np.int64, np.int32, np.int64, np.int64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, types)], names=names)

    names = [c.split()[0] for c in _WINDOWS.split(", ")]
    return texts.select("text", "runs").mapInArrow(windows, _WINDOWS)


def covered_words(n: int, marks: list[dict], min_words: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks:
        first, count = divmod(m["run"], STEP)
        at = first + np.flatnonzero([m["mask"] >> b & 1 for b in range(count)])
        edge[at] += 1
        np.subtract.at(edge, at + min_words, 1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(texts: DataFrame, min_words: int) -> DataFrame:
    def remove(batches):
        for batch in batches:
            rows = []
            for data, marks in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = data.tobytes().split()
                if not marks:
                    rows.append((len(words), 0, b" ".join(words).decode(), []))
                    continue
                gone = covered_words(len(words), marks, min_words)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((len(words), int(gone.sum()), kept.decode(), spans))
            columns = list(zip(*rows)) if rows else [[]] * 4
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    names = [c.split()[0] for c in _RESULT.split(", ")[:4]] + ["spans"]
    return texts.select("doc_id", "text", "marks").mapInArrow(remove, _RESULT)


def dedup_substrings(docs: DataFrame, min_words: int = 35, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by
    one space) and ``spans`` (maximal removed runs of words)."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    key = ["doc_id", "text_hash"]

    def with_text(per_doc: DataFrame, column: str, how: str, texts: DataFrame) -> DataFrame:
        other = per_doc.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), column)
        same = texts["doc_id"].eqNullSafe(other["own_id"]) & (texts["text_hash"] == other["own_hash"])
        return texts.join(other.hint("shuffle_hash"), same, how)

    anchors = scratch.table(find_anchors(rows, min_words), "anchors")
    repeated = scratch.table(anchors.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("segment").alias("least"), F.max("segment").alias("most")
    ).where("n > 1").select(F.col("anchor").alias("repeated"), (F.col("least") != F.col("most")).alias("mixed")), "repeated")
    seeds = scratch.table(anchors.join(repeated, F.col("anchor") == F.col("repeated")).drop("repeated"), "seeds")
    scratch.drop("anchors", "repeated")

    mixed = seeds.where("mixed")
    segments = scratch.table(mixed.groupBy("anchor", "segment").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "run")).alias("at")), "segments")
    read = segments.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct(F.col("at.run").alias("run"), "anchor", "segment", "copies")).alias("runs"))
    read = scratch.table(read, "read")
    texts = rows
    if read.count() <= broadcast_ids:  # then their ids spare the other texts the shuffle
        ids = F.broadcast(read.select(F.col("doc_id").alias("own_id")).distinct())
        texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["own_id"]), "left_semi")
    # Rows with the same id and text are one text here.
    windows = scratch.table(extend(with_text(read, "runs", "inner", texts).dropDuplicates(key), min_words), "windows")
    scratch.drop("read", "segments")
    again = scratch.table(windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select(
        F.col("anchor").alias("own_anchor"), F.col("window").alias("own_window")), "again")
    masks = windows.join(again, (F.col("anchor") == F.col("own_anchor")) & (F.col("window") == F.col("own_window")), "left_semi")
    masks = scratch.table(masks.groupBy(F.col("anchor").alias("own_anchor"), F.col("segment").alias("own_segment")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "masks")
    scratch.drop("windows", "again")

    part = mixed.join(masks, (F.col("anchor") == F.col("own_anchor")) & (F.col("segment") == F.col("own_segment")))
    marks = seeds.where(~F.col("mixed")).select(*key, "run", F.lit(-1).cast("long").alias("mask")).unionByName(
        part.select(*key, "run", "mask"))
    marks = scratch.table(marks.groupBy(*key).agg(F.collect_list(F.struct("run", "mask")).alias("marks")), "marks")
    scratch.drop("seeds", "masks")
    return remove_repeats(with_text(marks, "marks", "left", rows), min_words)

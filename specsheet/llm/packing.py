"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Every document's ids are cut into pieces of ``size`` and a rest. The number of pieces of each length
(at most ``size`` numbers) is all that the packing needs: lengths are placed longest first, each
into the emptiest open pack that holds it, and a pack stands for every pack of the same pattern by
its count. Patterns come back to documents by rank: the r-th piece of a length takes the r-th place
that the patterns have for it. Ranks are a task's own counts plus prefix sums over the counts per
task, so neither the full pieces nor any other length meets in one task.

Cases: a null text is empty and holds the end id alone; repeated rows and ids are packed each; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .token_files import crc32_u4
from .tokens import encode_rows

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, place long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold ``counts[length]`` pieces of each length."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    for length in range(size, 0, -1):
        left = counts.get(length, 0)
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=None)
            if room is None:
                open_packs[size - length].append((left, (length,)))
                break
            n, lengths = open_packs[room].pop()
            used = min(n, left)
            open_packs[room - length].append((used, (*lengths, length)))
            if n > used:
                open_packs[room].append((n - used, lengths))
            left -= used
    return [pack for _, packs in sorted(open_packs.items()) for pack in packs]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the ranks at which its places begin, and the sequence and offset of each first
    place (places of one pattern lie in consecutive sequences)."""
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            table[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in table.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """One row per piece with the writing task and its place among that task's equal lengths."""

    def cut(batches):
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            columns: list[list] = [[] for _ in range(7)]
            for i, ids in encode_rows(batch.column(1), tokenizer_path):
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    row = (doc_ids[i], start, len(piece), crc32_u4(piece), len(ids), task, seen[len(piece)])
                    seen[len(piece)] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = [c.split()[0] for c in _PIECES.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024) -> DataFrame:
    """The pieces of all documents with their sequence and offset in it."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(cut_pieces(docs, tokenizer_path, size), "pieces")
    counts = scratch.table(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(pack_histogram(histogram, size))  # bounded by ``size``, not by the documents

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length).tolist():
                rows = np.flatnonzero(length == value)
                first, at_sequence, at_offset = table[value]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = at_sequence[k] + rank[rows] - first[k]
                offset[rows] = at_offset[k]
            kept = [batch.column(n) for n in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    names = [c.split()[0] for c in _PACKED.split(", ")]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.select(*names[:5], "rank").mapInArrow(place, _PACKED)

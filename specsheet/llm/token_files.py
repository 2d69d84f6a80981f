"""Token files: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Documents are range-partitioned and sorted by id; each task encodes its rows and streams the ids
into a file of its own, named afresh for every attempt. The rows a task returns name the file it
finished, so a lost executor or a second attempt never leaves half a file in use. The number of ids
before each file (its base) is a prefix sum over one row per file.

Cases: a null text is empty and yields the end id alone; null ids sort first; rows with equal ids
all stay, in the order of their texts' first 32 signs and a hash of them; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encode_rows

NO_ID = -(1 << 63)  # stands for a null id in the id file
_MANIFEST = "part int, file string, dtype string, docs long, tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def crc32_u4(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4"))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode every text and write the files below ``folder`` (any URI that pyarrow opens; shared
    by all executors). Returns the manifest, one row per file with ``base_doc`` and ``base_token``,
    also written as ``manifest``. A file ``x`` is ``x.bin`` (ids), ``x.idx`` (offsets in ids,
    unsigned 64 bits, one more than documents) and ``x.doc`` (document ids, signed 64 bits)."""

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, ids_of, offsets, dtype = None, [], [0], ""
        for batch in batches:
            for i, ids in encode_rows(batch.column(1), tokenizer_path):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.bin", buffer_size=1 << 20)
                    dtype = ids.dtype.str
                out.write(ids.tobytes())
                offsets.append(offsets[-1] + len(ids))
            ids_of.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        for suffix, values in (("idx", np.array(offsets, "<u8")), ("doc", np.concatenate(ids_of).astype("<i8"))):
            with fs.open_output_stream(f"{root}/{name}.{suffix}") as f:
                f.write(values.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [TaskContext.get().partitionId()], "file": [name], "dtype": [dtype],
             "docs": [len(offsets) - 1], "tokens": [offsets[-1]]},
            schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("dtype", pa.string()),
                              ("docs", pa.int64()), ("tokens", pa.int64())]))

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows without an id, or with one repeated id, are spread by their texts.
    keys = ["doc_id", F.coalesce(F.substring("text", 1, 32), F.lit("")), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = sorted(ordered.mapInArrow(write, _MANIFEST).collect())  # one small row per file
    doc, token, manifest = 0, 0, []
    for f in files:  # the prefix sums
        manifest.append((*f, doc, token))
        doc, token = doc + f.docs, token + f.tokens
    out = spark.createDataFrame(manifest, f"{_MANIFEST}, base_doc long, base_token long")
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return out


class FileInts:
    """A file's integers by range: memory-mapped where the file system is local, else read range by range."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.map = np.memmap(path, dtype=dtype, mode="r") if local and os.path.getsize(path) else None
        self.file = None if local else fs.open_input_file(path)
        self.size = (len(self.map) if self.map is not None else 0) if local else self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return self.map[at] if self.map is not None else np.zeros(0, self.dtype)
        begin, end = max(0, at.start), min(at.stop, self.size)
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, end - begin) * width, begin * width), dtype=self.dtype)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` themselves (array of longs)."""

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['file']}"
                tokens = FileInts(fs, f"{path}.bin", row["dtype"])
                offsets, doc_ids = FileInts(fs, f"{path}.idx", "<u8"), FileInts(fs, f"{path}.doc", "<i8")
                for at in range(0, doc_ids.size, 512):
                    part, cuts = doc_ids[at : at + 512], offsets[at : at + 513].astype(np.int64)
                    ids = tokens[int(cuts[0]) : int(cuts[-1])]
                    spans = list(zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist()))
                    columns = [
                        pa.array(part, pa.int64(), mask=part == NO_ID), pa.array(cuts[:-1] + row["base_token"]),
                        pa.array(np.diff(cuts)), pa.array([crc32_u4(ids[a:b]) for a, b in spans], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _READ + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").mapInArrow(read, schema)


def token_offsets(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (below the session's shared folder by default) and read
    every document's place and checksum back from them."""
    folder = folder or Scratch(docs.sparkSession, "token-files").path
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)

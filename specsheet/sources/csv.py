"""SRC-1/2: spec-sheet CSV files -> raw all-string table with a required-column check.

A quoted value may hold line breaks, so a reader that starts in the middle of a file cannot tell whether a
line begins a record. ``read_records`` finds out with quote parity: a line begins a record if an even
number of quotes stands before it in its file. Every split (a byte range) counts its own quotes; prefix
sums over the splits of a file say with which parity each begins; within a split the parity runs
along with its lines. So one large file is read by many tasks, records that span lines or splits
are put together by their first line, and all others never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The header names a spec-sheet CSV must carry, and the raw-layer names they
# are renamed to.
REQUIRED_COLUMNS = [
    "Company Names", "Cars Names", "Engines", "CC/Battery Capacity",
    "HorsePower", "Total Speed", "Performance(0 - 100 )KM/H",
    "Cars Prices", "Fuel Types", "Seats", "Torque",
]
RAW_NAMES = [
    "company_names", "cars_names", "engines", "cc_battery",
    "horsepower", "total_speed", "accel_0_100",
    "cars_prices", "fuel_types", "seats", "torque",
]


def check_required(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns in the header: {missing}")


def _read(spark: SparkSession, path: str | list[str], encoding: str, multi_line: bool) -> DataFrame:
    try:
        return (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
                .option("encoding", encoding).option("multiLine", multi_line).csv(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"no file at {path}") from e
        raise


def _with_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's number within its split (``seq``), whether the quotes before it in the split are odd
    (``before``) and its own number of quotes is (``odd``). A task reads a split's lines in order."""
    at, number, parity = None, 0, 0
    for batch in batches:
        file, block, value = (batch.column(c) for c in ("file", "block", "value"))
        odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        ids = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = block.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])) + 1
        seq, before = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(odd)]):
            if a == b:
                continue
            key = (file[a].as_py(), int(starts[a]))
            if key != at:
                at, number, parity = key, 0, 0
            run = np.cumsum(odd[a:b])
            seq[a:b] = number + np.arange(b - a)
            before[a:b] = (parity + run - odd[a:b]) & 1
            number, parity = number + b - a, int((parity + run[-1]) & 1)
        yield pa.RecordBatch.from_arrays([file, block, value, pa.array(seq), pa.array(before), pa.array(odd)],
                                         names=["file", "block", "value", "seq", "before", "odd"])


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of CSV files as ``file``, ``block`` (where the split begins), ``seq`` (its line there) and
    ``value`` (bytes, line breaks within it as ``\\n``). Quotes must be paired, as in RFC 4180: one inside
    an unquoted value would turn the parity of all that follows."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"no file at {path}") from e
        raise
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    scanned = lines.mapInArrow(_with_parity, "file string, block long, value binary, seq long, before long, odd long")
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value").cast("string"), F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("parity"))
    splits = splits.select("file", "block", F.coalesce(F.sum("parity").over(by_file) % 2, F.lit(0)).alias("begins"))
    inside = (F.col("before") + F.col("begins")) % 2 == 1
    lines = scanned.join(splits, ["file", "block"]).select(
        "file", "block", "seq", "value", inside.alias("inside"), (inside != (F.col("odd") == 1)).alias("goes_on"))
    whole = lines.where(~F.col("inside") & ~F.col("goes_on")).select("file", "block", "seq", "value")

    parts = lines.where(F.col("inside") | F.col("goes_on"))  # lines of records of several lines
    opens = F.when(~F.col("inside"), F.col("seq"))
    in_split = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("first", F.last(opens, ignorenulls=True).over(in_split))
    last_open = parts.groupBy("file", "block").agg(F.max(opens).alias("opened"))
    earlier = F.last(F.when(F.col("opened").isNotNull(), F.struct("block", "opened")), ignorenulls=True).over(by_file)
    carried = last_open.select("file", "block", earlier.alias("earlier")).where(F.col("earlier").isNotNull())
    parts = parts.join(carried, ["file", "block"], "left")
    here = F.col("first").isNotNull()
    parts = parts.select("file", F.when(here, F.col("block")).otherwise(F.col("earlier.block")).alias("from_block"),
                         F.when(here, F.col("first")).otherwise(F.col("earlier.opened")).alias("from_seq"), "block", "seq", "value")
    joined = parts.groupBy("file", "from_block", "from_seq").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("lines"))
    # As ISO-8859-1 every byte is one sign, so nothing is lost before the file's encoding is known.
    text = F.array_join(F.transform("lines", lambda x: F.regexp_replace(F.decode(x["value"], "ISO-8859-1"), "\r$", "")), "\n")
    several = joined.select("file", F.col("from_block").alias("block"), F.col("from_seq").alias("seq"), F.encode(text, "ISO-8859-1").alias("value"))
    return whole.unionByName(several)


def read_quoted(spark: SparkSession, path: str | list[str], encoding: str = "auto") -> DataFrame:
    """CSV files with a header line each, all columns as strings, plus ``row_id``: ascending in the order of files
    (by path) and of records, not dense. ``encoding='auto'`` takes files that are not valid UTF-8 for
    ISO-8859-1, file by file."""
    columns = _read(spark, path, "UTF-8", False).columns  # of the header
    records = read_records(spark, path)
    if encoding == "auto":
        odd = spark.read.option("lineSep", "\n").text(path).where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("file")).distinct()
        records = records.join(odd.withColumn("latin", F.lit(True)), "file", "left")
        text = F.when(F.col("latin"), F.decode("value", "ISO-8859-1")).otherwise(F.col("value").cast("string"))
    else:
        text = F.decode("value", encoding)
    text = F.regexp_replace(F.regexp_replace(text, "\r$", ""), "^\ufeff", "")
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")  # file names and lengths alone
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.select(F.col("path").alias("own_path"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    header = (F.col("block") == 0) & (F.col("seq") == 0)
    rows = records.where(~header).select("file", "block", "seq", text.alias("text")).where(F.trim("text") != "")
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    parsed = F.from_csv("text", schema, {"escape": '"', "maxCharsPerColumn": "-1"})
    name = lambda c: F.url_decode(F.regexp_extract(c, r"^[a-z]+:/*(.*)$", 1))  # noqa: E731  file:/x and file:///x are one path
    rows = rows.join(files.select(name("own_path").alias("name"), "base"), name(F.col("file")) == F.col("name"))
    return rows.select((F.col("base") + F.col("block") + F.col("seq")).alias("row_id"), parsed.alias("r")).select(
        "row_id", *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


def load_specs_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "auto",
    required: Sequence[str] = REQUIRED_COLUMNS,
    rename: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read spec-sheet CSV(s) with every column as string.

    Quoted values may hold doubled quotes and, with ``multi_line``, line breaks; files are split among tasks in
    either case. ``encoding='auto'`` takes files that are not valid UTF-8 for ISO-8859-1, file by file. Adds
    ``row_id``, ascending in file order (not dense).
    """
    if multi_line:
        df = read_quoted(spark, path, encoding)
        check_required(df, required)
    else:
        df = _read(spark, path, "UTF-8" if encoding == "auto" else encoding, False)
        check_required(df, required)
        if encoding == "auto":
            odd = spark.read.text(path).where(~F.is_valid_utf8("value")).select("_metadata.file_path").distinct()
            other = [r[0] for r in odd.collect()]  # file names
            if other:
                rest = df.where(~F.col("_metadata.file_path").isin(other)).select(*[f"`{c}`" for c in df.columns])
                df = rest.unionByName(_read(spark, other, "ISO-8859-1", False))
        df = df.select(F.monotonically_increasing_id().alias("row_id"), *[f"`{c}`" for c in df.columns])
    if rename:
        mapping = dict(zip(REQUIRED_COLUMNS, RAW_NAMES))
        df = df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])
    return df

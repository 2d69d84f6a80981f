"""Benchmark decontamination: a broadcast hash set of test n-grams against training word windows.

Texts and items are normalised the same way: A-Z lower-cased, then maximal runs of letters, digits
and non-ASCII characters. Every window of ``n`` words of an item (the whole item if it has fewer) is
one key. Each document's windows are hashed where they stand and probed against the broadcast keys;
the words of a hit are then compared, so a hash collision never counts. DataFrame functions only;
the only rows that are shuffled are one per document plus one per hit. The keys are broadcast up to
``broadcast_windows`` of them; beyond it windows and keys meet in a shuffled equi-join.

Cases: a null or wordless text has no words and is clean; a wordless item matches nothing; items
with a null id mark words but are not counted; repeated documents and items are judged each;
an empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, own_names
from .url_filter import LOWER, UPPER

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the faster builtin where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def windows_of(words: Column, length: int) -> Column:
    """Hash of every run of ``length`` words, by its first word."""
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        F.slice(words, i + 1, length)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row per distinct window: ``window`` (words), ``key`` and the ids of the items that have it."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    starts = items.select("item_id", "words", length.alias("length"), F.explode(
        F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    rows = starts.select("item_id", F.slice("words", F.col("at") + 1, F.col("length")).alias("window")).distinct()
    return rows.groupBy("window").agg(F.collect_list("item_id").alias("items")).withColumn("key", F.xxhash64("window"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 2_000_000) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (distinct ids
    of items with a window in it) and ``contaminated``."""
    windows = benchmark_windows(benchmark, n)
    lengths = windows.groupBy(F.size("window").alias("length")).agg(F.count(F.lit(1)).alias("windows")).collect()
    small = sum(r.windows for r in lengths) <= broadcast_windows  # at most n rows collected
    keys = windows.select("key", "window", "items")
    if small:
        keys = F.broadcast(keys)

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"),
                        item_words(F.col("text")).alias("words"))
    no_hash = F.array(F.lit(None).cast("bigint"))  # one row more for each document, which never joins
    hashes = [F.struct(F.lit(r.length).alias("length"), windows_of(F.col("words"), r.length).alias("hashes")) for r in lengths]
    hashes.append(F.struct(F.lit(0).alias("length"), no_hash.alias("hashes")))
    by_length = words.select("*", F.size("words").alias("n_words"), F.inline(F.array(*hashes)))
    probes = by_length.select("row", "doc_id", "text_hash", "n_words", "words", "length", F.posexplode("hashes").alias("at", "hash"))
    own = F.slice("words", F.col("at") + 1, F.col("length"))
    if small:
        joined = probes.join(keys, (F.col("hash") == F.col("key")) & (own == F.col("window")), "left")
    else:
        joined = probes.withColumn("own", own).drop("words").join(
            keys, (F.col("hash") == F.col("key")) & (F.col("own") == F.col("window")), "left")
    hit = F.col("window").isNotNull()
    found = joined.where(hit | F.col("hash").isNull()).select(
        "row", "doc_id", "text_hash", "n_words", "items",
        F.when(hit, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("length")).alias("to"))).alias("span"))
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["to"], s["to"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["to"], s["from"]))).alias("n")), lambda a: a["n"])
    return merged.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
        F.array_distinct(F.flatten("items")).alias("items"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    own_id, own_hash = own_names("id", "hash")
    bad = find_contamination(docs, benchmark, n).where("contaminated").select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    bad = Scratch(docs.sparkSession, "contaminated").lookup(bad, "bad")
    same = bad[own_id].eqNullSafe(docs["doc_id"]) & (bad[own_hash] == F.xxhash64(docs["text"]))
    return docs.join(bad, same, "left_anti")

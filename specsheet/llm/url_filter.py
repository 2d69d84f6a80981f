"""URL filter: host-suffix and path-prefix expressions against hashed allow and block rules.

Each URL is expanded into the expressions that a rule could name: host suffixes with as many labels
as some rule host has, joined with path prefixes as long as some rule path is. Expressions meet
rules in an equi-join on the first 32 bits of their SHA-256 digest, the full digest confirms the
match, and the longest fitting rule decides (then the longer host, then block before allow).
DataFrame functions only. Rules go by broadcast up to ``broadcast_rules`` rows; beyond it the
planner shuffles.

Cases: a URL that is null or has no ``://`` has empty host and path and fits no rule unless the
rule is for the empty host; no fitting rule gives ``default``; repeated rows are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id",
                default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the deciding rule, or null), verdict.
    ``rules`` has verdict, host and path."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    n_rules, labels, lengths = rules.select(
        F.count(F.lit(1)), F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    digest = F.sha2(F.concat("host", "path"), 256)
    keyed = rules.select(F.substring(digest, 1, 8).alias("short"), digest.alias("digest"), F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"),
        (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "verdict").alias("match"))
    if n_rules <= broadcast_rules:
        keyed = F.broadcast(keyed)

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                        F.monotonically_increasing_id().alias("row"))
    counts = F.filter(F.array(*[F.lit(k) for k in sorted(labels)]).cast("array<int>"),
                      lambda k: k <= F.size(F.split("host", r"\.")))
    cuts = F.filter(F.array(*[F.lit(k) for k in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("path"))
    digests = F.flatten(F.transform(counts, lambda k: F.transform(cuts, lambda n: F.sha2(
        F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -k), F.substring(F.col("path"), F.lit(1), n)), 256))))
    expanded = urls.select("row", "page_id", "host", "path", F.explode_outer(digests).alias("own"))
    joined = expanded.withColumn("own_short", F.substring("own", 1, 8)).join(
        keyed, (F.col("own_short") == F.col("short")) & (F.col("own") == F.col("digest")), "left")
    judged = joined.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max("match").alias("match"))
    return judged.select("page_id", "host", "path", F.col("match.rule").alias("rule"),
                         F.coalesce("match.verdict", F.lit(default)).alias("verdict"))

"""One query per operator, applied with its production parameters to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def default_tokenizer() -> str:
    """Path of the tokenizer file of op2 and op3, from an installed library that nothing else needs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@register("op2_token_files")
def op2_token_files(spark, sf_dir):
    from .token_files import token_offsets

    return token_offsets(read_table(spark, sf_dir, "documents"), default_tokenizer())


@register("op3_packing")
def op3_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), size=1024)


@register("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    from .licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


@register("op9_url_filter", sql=r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, max({'n': length(h || p), 'rule': h || p, 'verdict': verdict}) AS m
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) AND h IS NOT NULL
  GROUP BY page_id, host, path)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM best
""")
def op9_url_filter(spark, sf_dir):
    from .url_filter import RULES, filter_urls

    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


@register("op5_decontamination", sql=f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, w[i + 1 : i + least(10, len(w))] AS win
  FROM b, UNNEST(range(CASE WHEN len(w) = 0 THEN 0 ELSE len(w) - least(10, len(w)) + 1 END)) AS t(i)),
lengths AS (SELECT DISTINCT len(win) AS n FROM win),
places AS (SELECT rid, i, n, w[i + 1 : i + n] AS win FROM d, lengths, UNNEST(range(greatest(len(w) - n + 1, 0))) AS t(i)),
hits AS MATERIALIZED (SELECT rid, i, n, item_id FROM places JOIN win USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
""")
def op5_decontamination(spark, sf_dir):
    from .decontaminate import find_contamination

    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), n=10)
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@register("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    from .secrets import secret_report

    return secret_report(read_table(spark, sf_dir, "documents"))


@register("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    from .quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


@register("op10_topk_search", sql=r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
""")
def op10_topk_search(spark, sf_dir):
    from .topk import top_k

    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


@register("op1_substring_dedup", sql=f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT rid, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM d, UNNEST(range(greatest(len(w) - 34, 0))) AS t(i)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (h)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (rid, p) GROUP BY rid),
gone AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
""")
def op1_substring_dedup(spark, sf_dir):
    from .substring_dedup import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"), min_words=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op4_jaccard_join", sql=f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s
  FROM d, UNNEST(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS t(i)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
""")
def op4_jaccard_join(spark, sf_dir):
    from .jaccard_join import link_documents

    return link_documents(read_table(spark, sf_dir, "documents"), n=3, percent=90)


@register("op12_simhash_dedup")
def op12_simhash_dedup(spark, sf_dir):
    from .simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"), n=3, distance=2)


def vector_codes_sql(rounds: int = 6) -> str:
    """Lloyd rounds on the parts as one chain of common table expressions."""
    usable = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, k AS part, e[k * (len(e) // 8) + 1 : (k + 1) * (len(e) // 8)] AS s FROM v, range(8) AS t(k)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s AS c
  FROM p JOIN (SELECT rid, vec_id FROM v ORDER BY vec_id NULLS LAST LIMIT 16) USING (rid))"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, part, min({{'d': list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': entry}}) AS best
  FROM p JOIN c{r} USING (part) GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY pos) AS c FROM (
    SELECT part, best.entry AS entry, pos, sum(s[pos])::BIGINT AS total, count(*) AS n
    FROM a{r} JOIN p USING (rid, part), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS pos) GROUP BY part, best.entry, pos) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m{r}.c, o.c) AS c FROM c{r} AS o LEFT JOIN m{r} USING (part, entry))""")
    return usable + "," + ",".join(steps) + f""",
coded AS (
  SELECT rid, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
book AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM c{rounds}))
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (rid) CROSS JOIN book"""


@register("op11_vector_codes", sql=vector_codes_sql())
def op11_vector_codes(spark, sf_dir):
    from .scratch import Scratch
    from .vector_codes import codebook_digest, compress_vectors

    codes, books = compress_vectors(read_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0, carry=("label",))
    codes = Scratch(spark, "op11").table(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))  # a row per label
    digests = spark.createDataFrame([(dim, codebook_digest(b)) for dim, b in books.items()], "length int, codebooks_sha256 string")
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).join(F.broadcast(digests), F.col("dim") == F.col("length"))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@register("op13_hard_negatives", sql=r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS a JOIN v AS c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives AS p JOIN scored AS s USING (anchor_id)
  WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score) WHERE rank <= 5
""")
def op13_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0), positives=5, negatives=5, percent=80, scale=256.0)

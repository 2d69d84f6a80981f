"""Quality classifier: document evidence with hierarchical empirical Bayes over hosts and paths.

Evidence: two logistic regressions (low quality, toxic) on hashed words, word beginnings, runs of
signs and shape, fitted with Spark ML on a bounded sample of labelled documents (``max_train``, in
hash order of their ids) and applied to every whole text. Site level: grouped sums of the documents'
probabilities give each host's and path's mean; variance between sites against variance within them
(over all documents) says how many documents a prior is worth, and each mean is shrunk by it, paths
towards their host and hosts towards the global mean. A document's final log odds are its evidence
plus its path's log odds relative to the global ones.

Cases: a null text is empty and judged by its shape; null hosts and paths are groups of their own;
labels without a document, or with a null, are left out, of repeated ids the largest values count;
without labels of both kinds a model says the observed rate; repeated rows are judged each; an empty
table gives no rows; other columns are ignored (``keep_documents`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import NO_WORD
from .scratch import Scratch, own_names
from .words import WHITE, mix, text_bytes, word_bounds, feature_hashes

BUCKETS = 1 << 16
TARGETS = ("low", "toxic")
_NO_SIGN = ~NO_WORD | WHITE


def features(text: bytes) -> np.ndarray:
    """Distinct feature buckets of a text."""
    data = np.frombuffer(text.lower(), np.uint8)
    starts, ends = word_bounds(data, NO_WORD)
    sign_starts, sign_ends = word_bounds(data, _NO_SIGN)
    words, signs = len(starts), len(sign_starts)
    shape = [1000 + words.bit_length(), 2000 + min(40, 10 * signs // (words + 1)),
             3000 + min(40, int(8 * np.log1p(len(data) / (words + 1))))]
    hashes = np.concatenate([
        feature_hashes(data, starts, ends),
        mix(feature_hashes(data, starts, np.minimum(starts + 4, ends)) ^ np.uint64(1)),
        mix(feature_hashes(data, sign_starts, sign_ends) ^ np.uint64(2)),
        mix(np.array(shape, np.uint64)),
    ])
    return np.unique(hashes % np.uint64(BUCKETS)).astype(np.int64)


def _texts(column):
    data, bounds = text_bytes(column)
    raw = memoryview(data)
    return (bytes(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def fit_evidence(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_train: int) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept per target."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    sample = known.groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by max_train

    def featurize(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [features(t) for t in _texts(some.column(0))]
                ends = np.append(0, np.cumsum([len(f) for f in found]))
                buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([buckets, some.column(1), some.column(2)], names=["buckets", *TARGETS])

    train = scratch.table(rows.select("text", *[F.col(t).cast("double").alias(t) for t in TARGETS]).mapInArrow(
        featurize, "buckets array<long>, low double, toxic double"), "train")
    seen = train.agg(F.count(F.lit(1)), *[F.sum(t) for t in TARGETS]).first()
    as_vector = F.udf(lambda b: Vectors.sparse(BUCKETS, b, [1.0] * len(b)), VectorUDT())  # of a bounded number of rows
    vectors = train.coalesce(8).select(as_vector("buckets").alias("features"), *TARGETS)
    out = []
    for target, hits in zip(TARGETS, seen[1:]):
        rate = ((hits or 0.0) + 0.5) / (seen[0] + 1.0)
        if not hits or hits == seen[0]:
            out.append((np.zeros(BUCKETS), float(np.log(rate / (1 - rate)))))
            continue
        model = LogisticRegression(featuresCol="features", labelCol=target, maxIter=25, regParam=0.002, standardization=False).fit(vectors)
        out.append((model.coefficients.toArray(), float(model.intercept)))
    return out


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site(columns: tuple[str, ...]) -> Column:
    """The columns' values as one string; a null and an empty value differ."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(columns)]))


def shrunk_sites(sites: DataFrame, keys: list[str], parent: DataFrame | None, up: list[str]) -> DataFrame:
    """Posterior mean per site and target: its own sum and ``kappa`` documents at the parent's mean.
    ``kappa`` is the within-site variance over the between-site variance, by moments."""
    own = sites.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"{t}_{s}").alias(f"{t}_{s}") for t in TARGETS for s in ("sum", "square")])
    parent = parent if parent is not None else own.agg(*[(F.sum(f"{t}_sum") / F.sum("n")).alias(f"{t}_up") for t in TARGETS])
    joined = own.join(parent, [own[k].eqNullSafe(parent[k]) for k in up] or None, "inner" if up else "cross").select(
        *[own[k] for k in keys], "n", *[f"{t}_{c}" for t in TARGETS for c in ("sum", "square", "up")])
    mean = {t: F.col(f"{t}_sum") / F.col("n") for t in TARGETS}
    spread = joined.agg(*[c for t in TARGETS for c in (
        (F.sum(F.col(f"{t}_square") - F.col("n") * mean[t] ** 2) / F.greatest(F.sum("n") - F.count(F.lit(1)), F.lit(1))).alias(f"{t}_within"),
        (F.sum(F.col("n") * (mean[t] - F.col(f"{t}_up")) ** 2) / F.sum("n")).alias(f"{t}_between"),
        (F.count(F.lit(1)) / F.sum("n")).alias(f"{t}_noise"))]).first()
    out = []
    for t in TARGETS:
        within = spread[f"{t}_within"] or 0.0
        between = max((spread[f"{t}_between"] or 0.0) - within * (spread[f"{t}_noise"] or 0.0), 1e-9)
        kappa = F.lit(min(max(within / between, 1.0), 1e9))
        out.append(((F.col(f"{t}_sum") + kappa * F.col(f"{t}_up")) / (F.col("n") + kappa)).alias(f"{t}_up"))
    return joined.select(*keys, *out)


def classify(docs: DataFrame, labels: DataFrame, host_cols: tuple[str, ...] = ("source",), path_cols: tuple[str, ...] = ("lang",),
             max_train: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, host, path, ``p_low``, ``p_toxic``, ``score``
    (probability of being good and not toxic) and ``keep``."""
    scratch = Scratch(docs.sparkSession, "quality")
    fitted = docs.sparkSession.sparkContext.broadcast(fit_evidence(docs, labels, scratch, max_train))
    scratch.drop("train")

    def score(batches):
        for batch in batches:
            scores = np.empty((len(fitted.value), batch.num_rows))
            for i, text in enumerate(_texts(batch.column(4))):  # a text's buckets at a time
                buckets = features(text)
                scores[:, i] = [w[buckets].sum() + at for w, at in fitted.value]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, scores)], names=names)

    names = ["doc_id", "text_hash", "host", "path", *TARGETS]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       site(host_cols).alias("host"), site(path_cols).alias("path"), "text")
    scored = scratch.table(rows.mapInArrow(score, "doc_id long, text_hash long, host string, path string, low double, toxic double"), "scored")
    p = {t: 1 / (1 + F.exp(-F.col(t))) for t in TARGETS}
    sites = scratch.table(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(p[t]).alias(f"{t}_sum") for t in TARGETS],
        *[F.sum(p[t] ** 2).alias(f"{t}_square") for t in TARGETS]), "sites")
    overall = sites.agg(*[(F.sum(f"{t}_sum") / F.sum("n")).alias(f"{t}_all") for t in TARGETS])
    hosts = shrunk_sites(sites, ["host"], None, [])
    paths = shrunk_sites(sites, ["host", "path"], hosts, ["host"])
    priors = scratch.table(paths.join(F.broadcast(overall)), "priors")  # one row of overall rates
    odds = {t: F.col(t) + _logit(F.col(f"{t}_up")) - _logit(F.col(f"{t}_all")) for t in TARGETS}
    final = {t: 1 / (1 + F.exp(-odds[t])) for t in TARGETS}
    joined = scored.join(priors, ["host", "path"])
    return joined.select("doc_id", "text_hash", "host", "path", final["low"].alias("p_low"), final["toxic"].alias("p_toxic"),
                         ((1 - final["low"]) * (1 - final["toxic"])).alias("score"),
                         ((final["low"] < threshold) & (final["toxic"] < threshold)).alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps."""
    own_id, own_hash = own_names("id", "hash")
    bad = classify(docs, labels, **options).where(~F.col("keep")).select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    bad = Scratch(docs.sparkSession, "quality-rejected").lookup(bad, "bad")
    same = bad[own_id].eqNullSafe(docs["doc_id"]) & (bad[own_hash] == F.xxhash64(docs["text"]))
    return docs.join(bad, same, "left_anti")

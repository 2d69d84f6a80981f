"""Shrunk site rates by hand, stage columns with clashing names, empty and repeated rows, very many matches in one
text, and the whole pipeline against brute force."""

import collections
import math
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from llm_fixtures import AWKWARD, LOWER, PLAIN_WORDS, documents
from pyspark.sql import functions as F
from test_near_duplicate_stage import brute_stage
from test_operators import TOKENIZER, corpus, labelled, prose

from specsheet.llm import decontaminate, hard_negatives, licenses, packing, quality, secrets, simhash, token_files, topk, url_filter, vector_codes
from specsheet.llm.jaccard_join import drop_near_duplicates
from specsheet.llm.scratch import Scratch

# ------------------------------------------------------------- 8: grouped shrinkage by hand


def shrink(groups, up_of):
    """``groups``: key -> list of probabilities; ``up_of(key)``: the parent's rate. Posterior rate per key."""
    n = sum(len(v) for v in groups.values())
    within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in groups.values()) / max(n - len(groups), 1)
    between = sum(len(v) * (np.mean(v) - up_of(k)) ** 2 for k, v in groups.items()) / n
    between = max(between - within * len(groups) / n, 1e-9)
    kappa = min(max(within / between, 1.0), 1e9)
    return {k: (sum(v) + kappa * up_of(k)) / (len(v) + kappa) for k, v in groups.items()}


def test_posteriors_against_hand_computed(spark, monkeypatch):
    kept = {}

    class Spy(Scratch):
        def table(self, df, name, rows=None):
            kept[name] = out = super().table(df, name, rows)
            return out

    monkeypatch.setattr(quality, "Scratch", Spy)
    rows, labels = labelled(spark)
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "").otherwise(
        F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))).withColumn("lang", (F.col("doc_id") % 3).cast("string"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    assert len({got[i].host for i in (0, 13)}) == 2  # a null and an empty host differ
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for target, name in (("low", "p_low"), ("toxic", "p_toxic")):
        evidence = {r["doc_id"]: (r["host"], r["path"], r[target]) for r in kept["scored"].collect()}
        hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
        for h, p, e in evidence.values():
            hosts[h].append(1 / (1 + math.exp(-e)))
            paths[h, p].append(1 / (1 + math.exp(-e)))
        overall = np.mean([x for v in hosts.values() for x in v])
        by_host = shrink(hosts, lambda k: overall)
        by_path = shrink(paths, lambda k: by_host[k[0]])
        for i, (h, p, e) in evidence.items():
            odds = e + logit(by_path[h, p]) - logit(overall)
            assert getattr(got[i], name) == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


# ------------------------------------------------------------- stages: clashing columns, no rows, repeated rows

CLASH = ["secret_spans", "own_id", "own_hash", "bad_id", "bad_hash", "gone", "near_duplicate_key", "key", "own", "stays", "keep", "spans", "fp", "component_id"]


def stages(spark):
    bench = spark.createDataFrame([(1, "same text here", 2)], "item_id long, text string, bad_id int")
    labels = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int, bad_hash int")
    return {"quality": lambda d: quality.keep_documents(d, labels), "near": lambda d: drop_near_duplicates(d, n=5, percent=80),
            "bench": lambda d: decontaminate.drop_contaminated(d, bench), "secrets": secrets.mask_secrets}


@pytest.mark.parametrize("name", ["quality", "near", "bench", "secrets"])
def test_stage_with_clashing_columns(spark, name):
    rows = corpus()[:40] + [(900, "password = 'k9Qz81LmPw' here"), (900, "password = 'k9Qz81LmPw' here")]
    plain = documents(spark, rows)
    clash = plain.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    stage = stages(spark)[name]
    out = stage(clash)
    assert out.schema == clash.schema
    got = out.collect()
    assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in got)
    same = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    assert same(got) == same(stage(plain).collect()) and got


def test_empty_and_repeated_rows_of_every_operator(spark):
    none, bench = documents(spark, []), spark.createDataFrame([(1, "same text here"), (1, "same text here")], "item_id long, text string")
    for name, stage in stages(spark).items():
        assert stage(none).count() == 0, name
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert licenses.scan_licenses(none).count() == 0 and secrets.secret_report(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).count() == 0
    twice = documents(spark, [(1, "same text here under the mit license"), (1, "same text here under the mit license"), (None, None), (None, None)])
    found = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.find_contamination(twice, bench).collect()), key=str)
    assert found == [(1, 7, 3, 1), (1, 7, 3, 1), (None, 0, 0, 0), (None, 0, 0, 0)]
    assert [(r.n_base, r.labels) for r in licenses.scan_licenses(twice).where("doc_id = 1").collect()] == [(1, "mit"), (1, "mit")]
    assert simhash.simhash_groups(twice).count() == 4 and packing.pack_documents(twice, TOKENIZER).count() == 4
    assert token_files.token_offsets(twice, TOKENIZER).count() == 4


def test_vector_operators_ignore_clashing_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(120)]
    plain = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    clash = plain.withColumns({c: F.lit(1) for c in ("dim", "cell", "near", "rank", "score", "query", "key", "own", "query_id", "n", "ids", "vectors", "place")})
    for op in (lambda v: topk.top_k(v, v.where("vec_id % 20 = 0"), k=3), lambda v: hard_negatives.hard_negatives(v, v.where("vec_id % 10 = 0")),
               lambda v: vector_codes.compress_vectors(v, carry=("label",))[0]):
        assert sorted(map(tuple, op(clash).collect())) == sorted(map(tuple, op(plain).collect()))


def test_token_files_of_one_id_use_several_files(spark, tmp_path):
    rows = [(None, f"text {i} of many {i * i}") for i in range(4000)] + [(7, f"other {i}") for i in range(2000)] + [(9, "z")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one file
    try:
        manifest = token_files.write_token_files(documents(spark, rows), str(tmp_path / "f"), TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 4 and max(r.docs for r in manifest.collect()) < 3000
    got = token_files.read_token_files(manifest, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    assert len(got) == 6001 and got[0].doc_id is None and got[-1].doc_id == 9
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got[::97])


def test_ranges_of_a_file_that_cannot_be_mapped(tmp_path):
    from pyarrow import fs as pafs

    np.arange(1000, dtype="<u2").tofile(tmp_path / "x.bin")
    remote = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())  # not a LocalFileSystem itself
    ints = token_files.FileInts(remote, "x.bin", "<u2")
    assert ints.size == 1000 and ints[10:20].tolist() == list(range(10, 20)) and ints[990:2000].tolist() == list(range(990, 1000))
    mapped = token_files.FileInts(pafs.LocalFileSystem(), str(tmp_path / "x.bin"), "<u2")
    assert mapped.size == 1000 and mapped[5:8].tolist() == [5, 6, 7]


# ------------------------------------------------------------- very long texts


def test_thirty_thousand_matches_in_one_text(spark):
    text = " ".join(f"password=k{i:05x}Qz{i * 7919 % 99991:05d}" for i in range(32_000))
    docs = documents(spark, [(1, text)])
    secrets.secret_report(documents(spark, [(1, "token=abcdefgh1")])).collect()  # code is compiled
    began = time.time()
    r = secrets.secret_report(docs).first()
    masked = secrets.mask_secrets(docs).first()
    assert r.n_assign == r.n_live == 32_000 and masked.text == " ".join(["[secret]"] * 32_000)
    assert time.time() - began < 60  # a quadratic way took 30 s and 90 s here
    began = time.time()
    many = licenses.scan_text(("mit license and apache license 2.0; " * 16_000).encode())
    assert many[1] == 32_000 and time.time() - began < 10


@pytest.mark.parametrize("value,live", [("latestA9f3kQz7Lm2", True), ("kQ9test7Zr1pWx", True), ("x9f8d7s6a5", True), ("test", False), ("my_test_key", False),
                                        ("your-key-here", False), ("EXAMPLEKEY", False), ("aaaaaaaa", False), ("123456", False), ("password1", False)])
def test_placeholders(spark, value, live):
    assert spark.createDataFrame([(value,)], "v string").select(secrets.is_plain(F.col("v"), "").alias("p")).first().p != live


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR MIT\nand more", "bsd-3-clause,gpl-2.0,mit"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2.0,mit"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted", "bsd"),
    ("THE ABOVE COPYRIGHT NOTICE and this permission notice shall be included in all copies", "mit"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License", "gpl,gpl-3.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 licence", "cc-by"),
    ("nothing of the kind", ""), ("submit licenses", ""),
])
def test_written_license_rules(text, labels):
    assert licenses.scan_text(text.encode())[5] == labels


# ------------------------------------------------------------- the pipeline


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    import random

    from tokenizers import Tokenizer

    rnd = random.Random(9)
    rows, labels = labelled(spark)
    passage = prose(rnd, 40)
    near = [prose(rnd, 80) for _ in range(6)]
    rows += [(600 + 10 * i + k, t + " word" * k) for i, t in enumerate(near) for k in range(3)]
    rows += [(700, prose(rnd, 30) + " " + passage + " " + prose(rnd, 9)), (701, prose(rnd, 50) + " password = 'k9Qz81LmPw'"), *[(800 + i, t) for i, t in enumerate(AWKWARD)]]
    folder = str(tmp_path / "tables")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    kept = [(i, t) for i, t in rows if i in keep]
    worded = [(i, t) for i, t in kept if (t or "").split()]
    kept = [(i, t) for i, t in kept if not (t or "").split() or i in brute_stage(worded, 5, 80)]
    window = PLAIN_WORDS.findall(passage.translate(LOWER))
    grams = {tuple(window[i : i + 10]) for i in range(len(window) - 9)}

    def clean(text):
        w = PLAIN_WORDS.findall((text or "").translate(LOWER))
        return not any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))

    kept = {i: (t or "").replace("password = 'k9Qz81LmPw'", "[secret]'") for i, t in kept if clean(t)}
    assert 700 not in kept and 701 in kept and 601 not in kept
    assert set(got) == set(kept)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, text in kept.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(n for n, _ in got[i].values()) == len(ids)
        for start, (n, crc) in got[i].items():
            assert crc == zlib.crc32(ids[start : start + n].tobytes()), (i, text)


def test_pipeline_of_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

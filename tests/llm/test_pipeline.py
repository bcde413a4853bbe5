"""Each stage of the pipeline against brute force, with the cases its docstring defines."""

import os
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cueloom.llm import decontam, langid
from cueloom.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
POLISH = "Wczoraj wieczorem poszliśmy do sklepu, żeby kupić chleb, mleko i jabłka, ale był już zamknięty, więc wróciliśmy do domu."
FINNISH = "Eilen illalla kävimme kaupassa ostamassa leipää, maitoa ja omenoita, mutta se oli jo suljettu, joten palasimme kotiin."
TURKISH = "Dün akşam ekmek, süt ve elma almak için dükkâna gittik ama kapanmıştı, bu yüzden eve geri döndük ve erkenden uyuduk."
BASE64 = "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSBzZW50ZW5jZQ Zm9vYmFyYmF6cXV4 eHl6enkxMjM0NTY3ODkw cXdlcnR5dWlvcA"
GIBBERISH = "qzx vkwj xqpt zzgh wqrx jkvp bnmq xzcv plkj wqzx vbnk qwrt zxcp jklw qpzv"


def stored(spark, rows):
    path = scratch_path(spark, "test-docs")
    spark.createDataFrame(rows, DOC).withColumn("row", F.lit("clash")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_language_id_rejects_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [POLISH, FINNISH, TURKISH, BASE64, GIBBERISH, None, "", "12 34 !"]
    mixed = docs.unionByName(spark.createDataFrame([(-1 - k, t, None, "x", 0) for k, t in enumerate(odd)], docs.schema))
    kept = {r.doc_id for r in pipeline.language_id(spark, mixed, SF).select("doc_id").collect()}
    assert not {k for k in kept if k < 0}
    # What the model keeps is what it gives a score over its own limit.
    model = langid.train(mixed.where(~langid.held_out(F.col("doc_id"))))
    want = set()
    for r in mixed.collect():
        if r.text and langid.has_letter(r.text):
            counts = np.bincount(langid.ngrams(r.text), minlength=langid.DIMENSIONS)
            unit = np.sqrt(counts) * model.weights
            cosines = model.centroids @ (unit / np.linalg.norm(unit))
            if cosines.max() >= model.limits[cosines.argmax()]:
                want.add(r.doc_id)
    assert kept == want
    known = {r.doc_id for r in docs.where("lang is not null").select("doc_id").collect()}
    assert len(known & kept) >= 0.99 * len(known)
    assert pipeline.language_id(spark, mixed.limit(0), SF).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[p : p + 3]) for p in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [" ".join(word() for _ in range(300)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(5, base[0])] * 3 + [(6, base[0])] + [(None, base[1])] * 3 + [(None, "only null keys here")] * 3
    rows += [(9, None), (8, ""), (8, " \t"), (20, base[2] + " x"), (21, base[3][:-3])]
    docs = stored(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows]).repartition(3)
    path = scratch_path(spark, "test-docs")
    docs.write.parquet(path)
    got = Counter((r.doc_id, r.text) for r in pipeline.near_dedup(spark, spark.read.parquet(path), SF).collect())
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                group = [group[b] if g == group[a] else g for g in group]
    want = Counter()
    for g in set(group):
        want[min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if group[k] == g)] += 1
    assert Counter((i is None, i or 0) for i, _ in got.elements()) == want
    assert pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_decontamination_cuts_and_drops(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(13))
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(1, f"{item} end"), (2, f"{long} ({item.upper()}). {long}"), (3, long), (4, None), (5, "..."), (2, f"{long} ({item.upper()}). {long}")]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = stored(spark, [(i, t, "en", "s", 7) for i, t in rows])
    got = Counter((r.doc_id, r.text, r.n_chars) for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect())
    cut = f"{long} (). {long}"
    assert got == Counter([(2, cut, len(cut))] * 2 + [(3, long, 7), (4, None, 7), (5, "...", 7)])
    found = decontam.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), keep=("text",)).where("doc_id = 2").first()
    assert [(s["start"], s["end"]) for s in found.spans] == [(400, 413)]


def test_stages_of_no_documents_and_columns(spark):
    docs = stored(spark, [(1, "x", "en", "s", 1)]).limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == pipeline.COLUMNS and out.count() == 0
    assert pipeline.encode(spark, docs, SF).count() == 0

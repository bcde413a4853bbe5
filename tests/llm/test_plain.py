"""Language ID, sharding and the encode stage against plain loops over every row."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import langid, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "the and ing tion er of to".split(), "de": "der und sch ein ung über ich".split(), "fr": "le que ment eau é à des".split()}


def corpus():
    rng = np.random.default_rng(16)
    rows = [(lang, " ".join("".join(rng.choice(p, 2)) for _ in range(rng.integers(2, 30)))) for lang, p in PARTS.items() for _ in range(40)]
    rows += [(None, "the of and"), ("en", None), ("de", ""), ("fr", "12 !"), ("und", "der und ein"), ("en", "THE End"), ("de", "x" * 5000)]
    return [(k, text, lang, "s", 0) for k, (lang, text) in enumerate(rows)]


def grams(text):
    """How often each dimension occurs, byte by byte."""
    kept = "".join(c if ord(c) >= 128 or c.isascii() and c.isalpha() else " " for c in text.lower())
    raw = b" " + " ".join(kept.split(" ")).encode()
    raw = b" " + b" ".join(w for w in raw.split()) + b" "
    out = {}
    for n in (1, 2, 3):
        for at in range(len(raw) - n + 1):
            code = int.from_bytes(raw[at : at + n], "big")
            mixed = (code + n * 0x3C6EF372) * 0x9E3779B1 % 2**32
            d = (mixed ^ (mixed >> 15)) * 0x85EBCA77 % 2**32 >> 19
            out[d] = out.get(d, 0) + 1
    return out


def test_language_id_against_plain_cosines(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOC).repartition(3)
    model = langid.train(df.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    learned = [grams(t) for k, t, lang, *_ in rows if zlib.crc32(str(k).encode()) % 4 != 2 and lang not in (None, "und") and t and any(c.isalpha() for c in t)]
    weight = lambda d: math.log((1 + len(learned)) / (1 + sum(d in g for g in learned))) + 1
    weights = [weight(d) for d in range(langid.DIMENSIONS)]
    assert np.allclose(weights, model.weights, rtol=1e-6)
    assert model.languages == ["de", "en", "fr"]
    for k, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert got[k] == ("und", 0.0)
            continue
        v = {d: math.sqrt(n) * weights[d] for d, n in grams(text).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[d]) for d, x in v.items()) / length for c in model.centroids]
        best = max(cosines)
        near = {model.languages[j // langid.CENTROIDS] for j, c in enumerate(cosines) if best - c < 1e-5}
        assert got[k][0] in near and abs(got[k][1] - min(1, max(0, best))) < 1e-4, text


def test_more_languages_than_a_model_may_have(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.train(spark.createDataFrame(corpus(), DOC))


def spark_hash(*values):
    """Spark's xxhash64 of longs: each hashed with the one before as its seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(int(v).to_bytes(8, "little", signed=True), seed=seed % 2**64).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def evened(sizes, shards):
    """The map in which one slot after the other moves, trying all that could."""
    of = [k % shards for k in range(len(sizes))]
    load = lambda s: sum(n for n, o in zip(sizes, of, strict=True) if o == s)
    while True:
        low = min(range(shards), key=lambda s: (load(s), s))
        for full in sorted(range(shards), key=lambda s: (-load(s), s)):
            gap = load(full) - load(low)
            able = [k for k, o in enumerate(of) if o == full and 0 < sizes[k] < gap]
            if able:
                of[min(able, key=lambda k: (abs(2 * sizes[k] - gap), k))] = low
                break
        else:
            return of


def test_sharding_against_a_plain_map(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECES", 1)  # slots of this size stay whole
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("ab é"), rng.integers(0, 60))) for _ in range(700)] + [None, "same", "same"]
    ids = [int(x) for x in rng.permutation(700)] + [900, 901, 901]
    slots, shards = 64, 5
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    out = sharding.assign(df, shards, slots=slots).collect()
    rows = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True)]
    slot = {r: spark_hash(r[0], r[2], r[1]) % slots for r in rows}
    of, want = evened([sum(r[1] for r in rows if slot[r] == s) for s in range(slots)], shards), []
    for s in range(shards):
        mine = sorted((r for r in rows if of[slot[r]] == s), key=lambda r: (slot[r], r[0], r[2], r[1]))
        want += [(*r, s, place) for place, r in enumerate(mine)]
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out) == sorted(want)


def test_encode_stage_against_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*corpus(), (None, "null key", "en", "s", 8), (3, "twice", "en", "s", 5), (3, "twice", "en", "s", 5)]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(rows, DOC).repartition(3), "")
    want = []
    for k, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        want.append((str(k), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == sorted(want)
    assert corpus_pipeline.encode(spark, spark.createDataFrame([], DOC), "").collect() == []

"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from cueloom.llm.common import scratch_path
from cueloom.llm.queries import oracle_sql, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    same(spark, queries()[name], oracle_sql()[name], SF)


#: The columns that each query has at least, and the table it gives a row for each row of.
CONTRACT = {
    1: ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    2: ("pages", "page_id url text n_chars"),
    3: ("documents", "doc_id n_words n_hit n_items items_sha256 contaminated"),
    4: ("documents", "doc_id n_tokens n_pretokens n_bytes"),
    5: ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    6: ("documents", "doc_id held_out lang_pred score"),
    7: ("embeddings", "vec_id n_links component_id kept"),
    8: ("documents", "doc_id fingerprint component_id"),
    9: ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    10: ("documents", "doc_id size text_crc32 law shard slot grown_shard"),
    11: ("embeddings", "vec_id code error label_error codebooks_sha256"),
    12: ("embeddings", "vec_id cluster distance cluster_inertia inertia centroid_sha256"),
    13: ("embeddings", "query_id rank vec_id score"),
}


@pytest.mark.parametrize("name", sorted(queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_every_query_gives_a_row_for_each(spark, name):
    source, columns = CONTRACT[int(name[2:].split("_")[0])]
    out = queries()[name](spark, SF)
    key = columns.split()[0]
    assert set(columns.split()) <= set(out.columns)
    rows = out.collect()
    if name.startswith("op13"):
        ids = [r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select("vec_id").collect()]
        assert sorted((r.query_id, r["rank"]) for r in rows) == [(v, k) for v in sorted(ids) if v % 50 == 0 for k in range(1, 6)]
        return
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    assert sorted(r[key] for r in rows) == want
    if name.startswith("op5"):
        # The base pays nothing for spelling words it has not seen, so it takes some text to beat it.
        larger = queries()[name](spark, SF.replace("sf0.001", "sf0.01"))
        score, base = larger.where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
        assert score > 0.98 * base
    if name.startswith("op6"):
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    if name.startswith("op10"):
        size = {s: sum(r["size"] for r in rows if r.shard == s) for s in range(24)}
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in size)
        assert sorted(size.values())[-2] - min(size.values()) <= 2 * max(r["size"] for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in docs.collect()} and whole

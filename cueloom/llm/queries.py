"""The queries of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import bpe, centroids, decontam, embeddup, html, langid, mixing, sharding, simhash, tokencount, veccodes, vptrees, warc
from cueloom.llm.common import drop_scratch, scratch_path, table


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(ids, path)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM windows), found AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k
), hits AS (
  SELECT DISTINCT doc_id, f.p + o AS at FROM found f SEMI JOIN windows v ON f.g = v.g AND f.k = v.k, unnest(range(0, f.k)) AS t(o)
), n AS (SELECT doc_id, count(*) AS n_hit FROM hits GROUP BY doc_id), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found JOIN windows USING (g, k)) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 7))
    return mixing.score(docs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links,
  (SELECT min(seen) FROM reach WHERE node = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(seen) FROM reach WHERE node = v.vec_id) AS kept
FROM v
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    told = warc.report(spark, path)  # reads the archive once, and keeps what it needs of it
    drop_scratch(spark, path)
    return told


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT *, sha1(body) AS hex, row_number() OVER (PARTITION BY body ORDER BY page_id) AS nth,
    first_value(page_id) OVER (PARTITION BY body ORDER BY page_id) AS first FROM p
)
SELECT page_id, strlen(body) AS payload_bytes,
  translate(array_to_string([to_base(('0x' || substr(hex, 5 * k + 1, 5))::BIGINT, 32, 4) FOR k IN range(8)], ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM h
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(table(spark, sf_dir, "embeddings"))


#: Rows of ``kept`` (vec_id, part, v) meet the entries of each round (part, c, v); what they are nearest to moves them.
_FITS = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs({0}::DOUBLE * x::DOUBLE) >= 67108864)) = 0"


def _rounds(n: int) -> str:
    """Assignments at_0 to at_n and books book_1 to book_n out of ``kept`` and book_0, a round after the other."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""at_{r} AS MATERIALIZED (SELECT k.vec_id, k.row, k.part, k.v, min(struct_pack(
    d := list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, b.v) + list_dot_product(b.v, b.v), c := b.c)) AS near FROM kept k JOIN book_{r} b USING (part) GROUP BY ALL)""")
        if r < n:
            steps.append(f"""sum_{r} AS (SELECT part, c, list(x ORDER BY p) AS v FROM (SELECT part, c, p, floor(sum(x) / count(*)) AS x
    FROM (SELECT part, near.c AS c, unnest(v) AS x, unnest(range(len(v))) AS p FROM at_{r}) GROUP BY part, c, p) GROUP BY part, c),
  book_{r + 1} AS MATERIALIZED (SELECT part, c, coalesce(s.v, b.v) AS v FROM book_{r} b LEFT JOIN sum_{r} s USING (part, c))""")
    return ",\n  ".join(steps)


OP11_SQL = f"""
WITH whole AS (
  SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings WHERE {_FITS.format(1024)}
), usual AS (
  SELECT * FROM whole WHERE len(v) = (SELECT len(v) FROM whole WHERE len(v) % 4 = 0 GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)
), kept AS MATERIALIZED (
  SELECT vec_id, row, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM usual, range(4) AS parts(part)
), first AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS c FROM usual QUALIFY c < 256
), book_0 AS MATERIALIZED (
  SELECT part, c, v FROM kept JOIN first USING (row)
), {_rounds(4)}, coded AS (
  SELECT row, string_agg(format('{{:02x}}', near.c), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM at_4 GROUP BY row
), digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, c, p)) AS codebooks_sha256 FROM (SELECT part, c, unnest(v) AS x, unnest(range(len(v))) AS p FROM book_4)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM usual JOIN coded USING (row), digest
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, 0 AS part, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE {_FITS.format(256)} AND len(embedding) = 64
), book_0 AS MATERIALIZED (
  SELECT part, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < 40
), {_rounds(5)}
SELECT vec_id, near.c::INT AS cluster, near.d::BIGINT AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(b.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM at_5 JOIN book_5 b ON b.c = near.c
"""


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptrees.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0").drop("row")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS row FROM embeddings
), usable AS (
  SELECT * FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), met AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM usable q JOIN usable c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM met
)
SELECT * FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_encode_decode, op2_html_extraction, op3_decontamination, op4_token_counts, op5_lm_scoring, op6_language_id, op7_embedding_near_dedup, op8_simhash_near_dedup, op9_warc, op10_sharding, op11_vector_codes, op12_centroid_clustering, op13_nearest_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op7_embedding_near_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_centroid_clustering": OP12_SQL, "op13_nearest_neighbours": OP13_SQL}

"""A training-corpus pipeline out of the operators of ``cueloom.llm``.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import bpe, decontam, langid, simhash
from cueloom.llm.common import drop_scratch, scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model recognises; it learns from those it may.

    A null text, or one without a letter, goes; so does one much further from every language than the
    documents that made it, such as one in an unknown language. A null lang is not learned from. Repeated
    rows stay or go together; columns that ``documents`` lacks are left out; no documents give none.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select(COLUMNS), model).where("NOT rejected").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest key, a null one last.

    Rows are told apart by their place in the stored table (a file scan numbers them alike each time it is
    read), so of repeated rows, and of rows with equal or null keys, one stays as well. Null, empty and blank texts
    are one group. No documents give none.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS)
    named = numbered.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"), "text")
    groups = simhash.near_duplicates(named, "key")
    kept = groups.where(F.col("key.row") == F.col("component_id.row")).select(F.col("key.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark passages contaminate, and cuts the passages out of the others.

    A document without any stays as it is, as do a null and a wordless text; n_chars of a text that was cut is
    counted anew; repeated rows each stay; no documents give none, and no benchmark leaves all.
    """
    keep = ("text", "lang", "source", "n_chars")
    found = decontam.contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), keep=keep)
    found = decontam.verdicts(decontam.cut_spans(found)).where("NOT contaminated")
    count = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", count).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again to prove them: the digests of both.

    A null or empty text has no ids; every row keeps its own; no documents give none.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), path)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("bpe_encode_decode", encode)]

#: No SQL: hashes, fingerprints and byte-pair merges are beyond it. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next is written, but for the last one,
    which the result reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_scratch(spark, before)
            before = path
    return docs

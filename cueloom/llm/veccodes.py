"""Vector codes: each part of a vector as the number of its nearest entry, by Hamerly's bounds.

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, each with a
codebook of its own that starts as that part of the vectors with the smallest ids. For each part a row
keeps one upper bound (of the distance to its entry) and one lower bound (of the distance to the second
nearest entry). While the upper bound stays strictly below the lower one, or below half the distance from
the entry to the nearest other, no other entry can be as near, and the part keeps its code unseen;
otherwise all entries are compared in integers, and ties go to the smaller number (Hamerly, "Making
k-means even faster", 2010). Codes, and so codebooks, are those of the plain form.

Cases: a vector that is null or holds a null or non-finite component is left out, and so is one with an
integer of 2^26 or more, whose distances a long could not hold. Codebooks need vectors of one length: the
one that most vectors have (ties: the smaller) of those that the parts divide; vectors of other lengths,
empty ones among them, are left out. Repeated rows each keep a row; of equal ids the smaller vector comes
first into the codebook, and null ids come last. Fewer vectors than entries give as many entries as there
are. Labels may be of any type that can be grouped; nulls are one label, and NaN another. An empty table
gives none. Columns beyond the three named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import lloyd

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Pieces that the rows of one label are dealt into where they meet their label's sum.
SALTS = 64


def hamerly(book: lloyd.Book, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """New codes and bounds in place; all entries are compared where the bounds leave a doubt."""
    todo = book.narrow(x, code, upper, lower)
    if len(todo):
        code[todo], upper[todo], lower[todo] = book.scan(x[todo])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is not left out."""
    if parts < 1 or not 0 < entries <= 256 or rounds < 0:
        raise ValueError("parts: 1 or more; entries: 1 to 256; rounds: 0 or more")
    x = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), lloyd.integers(vector, scale).alias("vec")).where(F.size("vec") > 0)
    lengths = x.groupBy(F.size("vec").alias("k")).count().where(F.col("k") % parts == 0)
    usual = lengths.orderBy(F.desc("count"), "k").first()
    x = x.where(F.size("vec") == (usual["k"] if usual else 0))
    first = x.select("id", "vec").orderBy(F.asc_nulls_last("id"), "vec").limit(entries).toArrow()["vec"].to_pylist()
    if not first:
        empty = x.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.col("error").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    books = np.split(np.array(first, dtype=np.int64), parts, axis=1)
    table, books = lloyd.cluster(x, ["id", "label"], books, rounds, hamerly)
    coded = table.where("part IS NULL").select("id", "label", "code", F.col("distance").alias("error"))
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    summed = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    dealt = summed.select(F.col("label").alias("its"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("its_salt"))
    met = coded.join(dealt, F.col("label").eqNullSafe(F.col("its")) & (F.col("salt") == F.col("its_salt")))
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return met.select(F.col("id").alias(key), text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

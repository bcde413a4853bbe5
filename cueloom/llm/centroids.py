"""Centroid clustering by exponion search.

Each vector keeps its centroid, an upper bound of the distance to it, and a lower bound of the distance
to the second nearest. A vector whose bounds leave a doubt is compared only with the centroids inside
a ball around its own: of radius twice the upper bound plus the distance from its centroid to the nearest
other, which holds the nearest two (Newling and Fleuret, "Fast k-means with accurate bounds", 2016).
Each centroid's list of the others by distance is sorted once a round, so the ball is a prefix of it;
prefixes are rounded up to powers of two, so that many vectors are compared at once. The radius is
inclusive, so a centroid as near as the best is always inside, and ties go to the smaller number.

Cases: a vector that is null, of another length, or with a null or non-finite component is left out, and
so is one with an integer of 2^26 or more, whose distances a long could not hold. The first centroids are
the vectors with the smallest SHA-256 of their id; of equal ids the smaller vector comes first, and null
ids come last. Fewer vectors than centroids give as many centroids as there are. Repeated rows each keep a
row. An empty table gives none. Columns beyond the two named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import lloyd

CENTROIDS, ROUNDS, SCALE, DIMENSION = 40, 5, 256, 64
#: Stands before the id in the text whose digest chooses the first centroids.
SEED = "2:"


def exponion(book: lloyd.Book, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """New codes and bounds in place; a vector in doubt is compared with the centroids in its ball."""
    todo = book.narrow(x, code, upper, lower)
    own = code[todo]
    for a in np.unique(own):
        mine = todo[own == a]
        radius = (2 * upper[mine] + book.nearest[a]) * (1 + 4 * lloyd.WIDE)
        inside = np.searchsorted(book.gaps[a], radius, side="right")
        width = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int), len(book.entries))
        for w in np.unique(width):
            some = mine[width == w]
            code[some], upper[some], lower[some] = book.scan(x[some], np.sort(book.order[a][:w]))


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is not left out."""
    if k < 1 or rounds < 0 or dimension < 1:
        raise ValueError("k, dimension: 1 or more; rounds: 0 or more")
    x = rows.select(F.col(key).alias("id"), lloyd.integers(vector, scale).alias("vec")).where(F.size("vec") == dimension)
    drawn = x.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("drawn"), "vec")
    first = drawn.orderBy(F.asc_nulls_last("drawn"), "vec").limit(k).toArrow()["vec"].to_pylist()
    if not first:
        empty = x.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    table, (centroids,) = lloyd.cluster(x, ["id"], [np.array(first, dtype=np.int64)], rounds, exponion)
    sums = table.where("part IS NOT NULL").groupBy("entry").agg(F.sum("inertia").alias("inertia")).collect()
    of = {r["entry"]: r["inertia"] for r in sums}
    # One row for each centroid: k rows, a parameter.
    facts = [(c, of.get(c, 0), sum(of.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = table.where("part IS NULL").select(F.col("id").alias(key), F.get("code", F.lit(0)).alias("cluster"), "distance")
    return found.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are compared by the distance of their unit vectors, a metric in which the nearest has the largest
cosine. A coarse tree, fitted on a bounded sample, sends each vector to a cell; cells are dealt into
shards of bounded size by row. Each shard is one task: it builds a vantage-point tree (a vantage point
halves the vectors at their median distance to it; each half knows the least and the largest such
distance) and searches it for the queries among its own vectors, which gives each a first bound.
The queries of a shard then visit other shards, in blocks. Pairs of shards meet as balls first, without
their vectors; a ball, or a half of a tree, is passed over where its triangle-inequality bound times
``factor`` is above the distance of the query's last neighbour so far. At factor one nothing that is
passed over can be nearer, and the search is exact; at a larger one the last neighbour found is at most
``factor`` times as far as the true one.

Whatever a tree leaves is scored by the cosine of the original vectors in double precision, computed row
by row, so that equal vectors score alike and ties go to the smaller id.

Cases: a vector that is null, empty or zero, or with a null or non-finite component takes no part, as
query or candidate; neither does one with a null id, which no result could name. Vectors meet only those
of their own length. Repeated rows are rows of their own: each is a candidate of the others, and each a
query, told apart by ``row``. A query with fewer candidates than k gets them all; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut, drop_scratch, scratch_path

NEIGHBOURS, FACTOR = 5, 1.0
#: Bytes of a shard's vectors in double precision, and of the sample that the coarse tree is fitted on.
SHARD_BYTES, SAMPLE_BYTES = 4 << 20, 2 << 20
#: Most vectors of a leaf; most shards whose queries visit another in one task; vectors of a sample's cell.
LEAF, VISITORS, FEWEST = 256, 16, 8
#: What distances and cosines may be off by.
NEAR_OFF, COSINE_OFF = 1e-7, 1e-12


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    scaled = even(raw)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def even(raw: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; nothing is rounded."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b."""
    a, b = even(a), even(b)
    return np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each of the unit vectors a to each of b."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Tree:
    """A vantage-point tree over unit vectors. Level by level each cell is halved; ``order`` has the
    vectors of the cells one after the other."""

    def __init__(self, unit: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(unit))
        self.levels: list[dict[str, np.ndarray]] = []
        bounds = [(0, len(unit))]
        while max((b - a for a, b in bounds), default=0) > leaf:
            level: dict[str, list] = {"vantage": [], "middle": [], "low": [], "high": []}
            halves = []
            for a, b in bounds:
                mine = self.order[a:b]
                point = unit[mine[0]]
                # The vector furthest from some other stands at the rim, where distances spread most.
                vantage = unit[mine[int(distances(unit[mine], point[None])[:, 0].argmax())]]
                far = distances(unit[mine], vantage[None])[:, 0]
                rank = far.argsort(kind="stable")
                self.order[a:b], far = mine[rank], far[rank]
                half = (b - a + 1) // 2
                level["vantage"].append(vantage)
                level["middle"].append(far[half - 1])
                level["low"] += [far[0], far[half] if half < len(far) else np.inf]
                level["high"] += [far[half - 1], far[-1]]
                halves += [(a, a + half), (a + half, b)]
            self.levels.append({k: np.array(v) for k, v in level.items()})
            bounds = halves
        self.bounds = bounds

    def least(self, queries: np.ndarray) -> np.ndarray:
        """A lower bound of each query's distance to the vectors of each leaf."""
        out = np.zeros((len(queries), 1))
        for level in self.levels:
            d = distances(queries, level["vantage"]).repeat(2, axis=1)
            out = np.maximum(out.repeat(2, axis=1), np.maximum(d - level["high"], level["low"] - d))
        return out

    def cell(self, queries: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all the medians each query lies."""
        at = np.zeros(len(queries), np.int64)
        for level in self.levels:
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries * level["vantage"][at]).sum(axis=1)))
            at = 2 * at + (d > level["middle"][at])
        return at


class Found:
    """The k best candidates of each query so far: by score, then by id. A candidate is told by its row."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.row = np.full((n, k), -np.inf), np.full((n, k), self.NONE), np.full((n, k), self.NONE)

    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def reach(self) -> np.ndarray:
        """Distance of each query's last neighbour so far; without one, more than any vector has."""
        last = self.last()
        return np.where(np.isinf(last), 4.0, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(last, -1))))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates (a query's number each, repeated as needed)."""
        touched, place = np.unique(who, return_inverse=True)
        owner = np.concatenate([place, np.repeat(np.arange(len(touched)), self.k)])
        score, ids, rows = (np.concatenate([new, old[touched].reshape(-1)]) for new, old in ((score, self.score), (ids, self.id), (rows, self.row)))
        order = np.lexsort([rows, ids, -score, owner])
        starts = np.searchsorted(owner[order], np.arange(len(touched)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.row[touched] = score[best], ids[best], rows[best]


class Shard:
    """A shard's vectors with their tree."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.raw, self.ids, self.rows = raw, ids, rows
        self.unit = unit_rows(raw)
        self.tree = Tree(self.unit, leaf)

    def search(self, raw: np.ndarray, rows: np.ndarray, found: Found, factor: float) -> int:
        """Improves ``found`` for the queries (raw vectors and their rows); the number of vectors compared."""
        unit, tree = unit_rows(raw), self.tree
        least = tree.least(unit) * factor
        compared = 0

        def visit(leaf: int, who: np.ndarray) -> int:
            a, b = tree.bounds[leaf]
            near = tree.order[a:b]
            close = unit[who] @ self.unit[near].T
            close[rows[who][:, None] == self.rows[near][None]] = -np.inf
            floor = np.maximum(found.last()[who], np.partition(close, -found.k, axis=1)[:, -found.k] if len(near) >= found.k else -np.inf)
            i, j = np.nonzero((close >= floor[:, None] - COSINE_OFF) & (close > -np.inf))
            if len(i):
                found.add(who[i], cosines(raw[who[i]], self.raw[near[j]]), self.ids[near[j]], self.rows[near[j]])
            return len(who) * len(near)

        # Each query's most promising leaf first; then the leaves that its bound does not rule out.
        first = least.argmin(axis=1)
        for leaf in np.unique(first):
            compared += visit(int(leaf), np.nonzero(first == leaf)[0])
        for leaf in range(len(tree.bounds)):
            who = np.nonzero((first != leaf) & (least[:, leaf] <= found.reach() + NEAR_OFF))[0]
            if len(who):
                compared += visit(leaf, who)
        return compared


def _coarse(sample: list, dim: int, cells: int) -> Tree | None:
    """The tree that sends vectors to cells: as many as asked for, of a few vectors of the sample each."""
    if cells < 2 or len(sample) < 2 * FEWEST:
        return None
    leaf = max(FEWEST, math.ceil(len(sample) / cells))
    return Tree(unit_rows(np.array(sample, dtype=np.float64).reshape(-1, dim)), leaf)


def nearest(rows: DataFrame, query: Column | str, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, shard_bytes: int = SHARD_BYTES, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score, row) of the k nearest of each row of which ``query`` (an expression over
    ``rows``) is true, among all other rows."""
    if k < 1 or not factor >= 1 or leaf < 2:
        raise ValueError("k, factor: 1 or more; leaf: 2 or more")
    spark = rows.sparkSession
    single = rows.schema[vector].dataType.elementType == T.FloatType()
    kind = np.dtype("<f4" if single else "<f8")
    asked = F.expr(query) if isinstance(query, str) else query
    x = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vec"), F.coalesce(asked, F.lit(False)).alias("asks"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = x.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda c: c != 0), F.lit(False))).withColumn("dim", F.size("vec"))

    # The coarse tree is for the length that most vectors have; others are dealt by row alone.
    lengths = x.groupBy("dim").count()
    usual = lengths.select("dim", F.col("count").alias("n"), F.sum("count").over(Window.partitionBy()).alias("all")).orderBy(F.desc("n"), "dim").first()
    dim, total, others = (usual["dim"], usual["n"], usual["all"] - usual["n"]) if usual else (1, 0, 0)
    size = max(leaf, shard_bytes // (8 * dim))
    coarse = None
    if total > size:
        drawn = x.where(F.col("dim") == dim).select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(max(2 * FEWEST, SAMPLE_BYTES // (8 * dim)))
        coarse = _coarse(drawn.toArrow()["vec"].to_pylist(), dim, math.ceil(total / size))

    def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            cells, dims = np.zeros(batch.num_rows, np.int32), batch.column("dim").to_numpy()
            mine = np.nonzero(dims == dim)[0]
            if coarse and len(mine):
                cells[mine] = coarse.cell(unit_rows(batch.column("vec").take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim)))
            yield batch.append_column("cell", pa.array(cells))

    routed = x.mapInArrow(route, T.StructType([*x.schema.fields, T.StructField("cell", T.IntegerType())]))
    # Pieces of each cell: one number for each of the coarse tree's cells, which are as few as its sample allows.
    in_cell = {r["cell"]: r["count"] for r in routed.where(F.col("dim") == dim).groupBy("cell").count().collect()} if coarse else {0: total}
    pieces = F.array(*(F.lit(math.ceil(in_cell.get(c, 1) / size)) for c in range(max(in_cell) + 1)))
    per = F.greatest(F.lit(leaf), F.floor(F.lit(shard_bytes) / (8 * F.col("dim"))))
    salts = F.when(F.col("dim") == dim, F.get(pieces, F.col("cell"))).otherwise(F.ceil(F.lit(others) / per))
    numbered = routed.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("salt", F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), salts)).cast("int"))
    built_type = "dim int, cell int, salt int, ids binary, rows binary, vecs binary, centre array<double>, radius double, n_queries int, q_ids binary, q_rows binary, q_vecs binary, best_ids binary, best_rows binary, best binary, reach double, reach_q double"

    def build(group: pa.Table) -> pa.Table:
        d = group["dim"][0].as_py()
        raw = pa.concat_arrays([c.flatten() for c in group["vec"].chunks]).to_numpy().astype(kind).reshape(-1, d)
        ids, own, asks = group["id"].to_numpy(), group["row"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False).astype(bool)
        order = own.argsort()
        raw, ids, own, asks = raw[order], ids[order], own[order], asks[order]
        shard = Shard(raw, ids, own, leaf)
        found = Found(int(asks.sum()), k)
        shard.search(raw[asks], own[asks], found, factor)
        middle = shard.unit.mean(axis=0)
        away = np.sqrt(((shard.unit - middle) ** 2).sum(axis=1))
        values = [d, group["cell"][0].as_py(), group["salt"][0].as_py(), ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), raw.tobytes(), middle.tolist(), float(away.max()), int(asks.sum())]
        values += [ids[asks].astype("<i8").tobytes(), own[asks].astype("<i8").tobytes(), raw[asks].tobytes(), found.id.astype("<i8").tobytes(), found.row.astype("<i8").tobytes(), found.score.tobytes(), float(found.reach().max(initial=-1)), float(away[asks].max(initial=0))]
        return pa.Table.from_pylist([dict(zip(built.names, values, strict=True))], schema=built)

    schema = T._parse_datatype_string(built_type)
    built = pa.schema([(f.name, {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in schema])
    path = scratch_path(spark, "vantage")
    dealt.select("dim", "cell", "salt", "id", "row", "asks", "vec").groupBy("dim", "cell", "salt").applyInArrow(build, schema).write.parquet(path)
    shards = spark.read.parquet(path)

    # Each shard with queries and each other shard of its length, as balls; then those that can matter.
    # A shard's number: its rank among the shards of its length, of which there is one for thousands of vectors.
    over = Window.partitionBy("dim")
    heads = shards.select("dim", "cell", "salt", "centre", "radius", "n_queries", "reach", "reach_q").withColumn("shard", F.row_number().over(over.orderBy("cell", "salt")) - 1)
    heads = cut(heads.withColumn("shards", F.count(F.lit(1)).over(over)))
    askers = heads.where("n_queries > 0").select("dim", F.col("shard").alias("block"), F.col("centre").alias("c"), "reach", "reach_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).where("block <> shard")
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    can = (apart - F.col("radius") - F.col("reach_q")) * factor <= F.col("reach") + NEAR_OFF
    visits = askers.join(heads.select("dim", F.col("shard").cast("long").alias("shard"), "cell", "salt", "centre", "radius"), ["dim", "shard"]).where(can).select("dim", "cell", "salt", F.col("block").alias("block"), F.floor(F.col("block") / VISITORS).alias("party"))
    names = heads.select("dim", F.col("shard").alias("block"), F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"))
    blocks = shards.where("n_queries > 0").select("dim", F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"), "q_ids", "q_rows", "q_vecs", "best_ids", "best_rows", "best").join(names, ["dim", "q_cell", "q_salt"]).drop("q_cell", "q_salt")
    guests = visits.join(blocks, ["dim", "block"])
    keys = ["dim", "cell", "salt", "party"]
    hosts = visits.select(*keys).distinct().join(shards.select("dim", "cell", "salt", "ids", "rows", "vecs"), ["dim", "cell", "salt"])
    hosts = hosts.select(*(F.col(c).alias(f"host_{c}") for c in keys), "ids", "rows", "vecs")
    out_type = "row long, query_id long, vec_id long, score double"
    long = lambda b: np.frombuffer(b, dtype="<i8")

    def result(rows_: np.ndarray, ids: np.ndarray, found_id: np.ndarray, score: np.ndarray, of: np.ndarray) -> pa.Table:
        return pa.table({"row": rows_[of], "query_id": ids[of], "vec_id": found_id, "score": score})

    def visit(host: pa.Table, guest: pa.Table) -> pa.Table:
        if not host.num_rows or not guest.num_rows:
            return result(*(np.empty(0, np.int64),) * 3, np.empty(0), np.empty(0, np.int64))
        d = host["host_dim"][0].as_py()
        shard = Shard(np.frombuffer(host["vecs"][0].as_buffer(), kind).reshape(-1, d), long(host["ids"][0].as_buffer()), long(host["rows"][0].as_buffer()), leaf)
        get = lambda name, t: np.concatenate([np.frombuffer(v.as_buffer(), t) for v in guest[name]])
        ids, own, raw = get("q_ids", "<i8"), get("q_rows", "<i8"), get("q_vecs", kind).reshape(-1, d)
        found = Found(len(ids), k)
        found.id, found.row, found.score = (get(name, t).reshape(-1, k) for name, t in (("best_ids", "<i8"), ("best_rows", "<i8"), ("best", "<f8")))
        shard.search(raw, own, found, factor)
        of, at = np.nonzero(np.isin(found.row, shard.rows))
        return result(own, ids, found.id[of, at], found.score[of, at], of)

    visited = hosts.groupBy(*(f"host_{c}" for c in keys)).cogroup(guests.groupBy(*keys)).applyInArrow(visit, out_type)

    def at_home(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                found_id, score = long(r["best_ids"]).reshape(-1, k), np.frombuffer(r["best"], "<f8").reshape(-1, k)
                of, at = np.nonzero(score > -np.inf)
                yield from result(long(r["q_rows"]), long(r["q_ids"]), found_id[of, at], score[of, at], of).to_batches()

    home = shards.where("n_queries > 0").select("q_ids", "q_rows", "best_ids", "best").mapInArrow(at_home, out_type)
    ranked = home.unionByName(visited).withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    out = cut(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "row"))
    drop_scratch(spark, path)
    return out

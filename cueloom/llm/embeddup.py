"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector x is kept as a scale s and int8 components q with x = s*q + e; the length of e is
computed in double precision. For two vectors the products of the int8 tiles (exact in float32 for
up to 1,040 dimensions; longer vectors are multiplied in float64) give s*t*(q.r), which is off by at
most |e| + (1 + |e|)*|f|. Only pairs whose product plus that bound reaches the threshold are
computed again in double precision, so no link is lost and none is added.

Only vectors of equal label (and length) are compared. Equal vectors become one class with a
multiplicity, so a vector that a third of the rows share is compared once. The classes of a label
are dealt into tiles by the signs of some components (near vectors mostly share them) and, where
those tiles are large, by hash. Tiles first meet as bounding boxes, without their vectors; pairs whose
boxes are further apart than linked vectors can be go no further, which loses nothing. Each pair
that is left is one task of bounded size, in which blocks are skipped by their boxes likewise.
A task returns sums and stars for each vector, never pairs; ``components`` joins the stars.

Cases: a null label, a null, empty or zero vector, or one with null or non-finite components links
with nothing; so do vectors of other lengths. Repeated rows each keep a row and count as other
vectors. Labels of any type are compared as they are, and components in their own precision (vectors of
float as float, others as double). A row with a null id counts as a link of others, but names no component and is not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut
from cueloom.llm.components import components

THRESHOLD = 0.98
#: Vectors of a tile: at least the first, at most the second, else growing as the root of the label's
#: size times the third, so that what the tiles' copies add to the shuffle grows slower than the pairs.
TILE, TILE_MOST, TILE_ROOT = 4096, 32768, 1024
#: Side of the blocks that a tile is multiplied in.
BLOCK = 1024


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scales, and upper bounds of the error's length, of unit vectors (double)."""
    scale = np.abs(vectors).max(axis=1) / 127
    q = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.sqrt(((vectors - scale[:, None] * q) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-12) + 1e-12


class Roots:
    """Groups of the numbers 0 to n - 1, joined many links at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            split = x != y
            if not split.any():
                return
            a, b, x, y = a[split], b[split], x[split], y[split]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    raw = vectors.astype(np.float64)
    # Largest component to 1 first: squares then neither overflow nor vanish.
    unit = raw / np.abs(raw).max(axis=1)[:, None]
    return unit / np.sqrt((unit**2).sum(axis=1))[:, None]


def reach_of(threshold: float) -> float:
    """Squared distance of linked unit vectors, at most."""
    return 2 - 2 * threshold + 1e-9


def compare_tiles(a: np.ndarray, b: np.ndarray | None, mult_a: np.ndarray, mult_b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of tile a, then b (None: a with itself), weighted by multiplicity, and the
    number of the group that the links put it in."""
    both = a if b is None else np.concatenate([a, b])
    mult = mult_a if b is None else np.concatenate([mult_a, mult_b])
    unit = unit_rows(both)
    q, scale, error = quantise(unit)
    q = q.astype(np.float32 if unit.shape[1] <= 1040 else np.float64)
    links, groups = np.zeros(len(both), dtype=np.int64), Roots(len(both))
    reach = reach_of(threshold)
    starts = range(0, len(a), BLOCK), range(0, len(a), BLOCK) if b is None else range(len(a), len(both), BLOCK)
    end = lambda at: min(at + BLOCK, len(a) if at < len(a) else len(both))
    boxes = {at: (unit[at : end(at)].min(axis=0), unit[at : end(at)].max(axis=0)) for at in {*starts[0], *starts[1]}}
    for i in starts[0]:
        for j in starts[1]:
            if b is None and j < i:
                continue
            gap = np.maximum(0, np.maximum(boxes[i][0] - boxes[j][1], boxes[j][0] - boxes[i][1]))
            if (gap**2).sum() > reach:
                continue
            x, y = slice(i, end(i)), slice(j, end(j))
            product = q[x] @ q[y].T
            bound = product * scale[x, None] * scale[None, y] + (error[x, None] + (1 + error[x, None]) * error[None, y])
            m, n = np.nonzero(bound >= threshold - 1e-9)
            m, n = m + i, n + j
            if b is None and i == j:
                m, n = m[m < n], n[m < n]
            for at in range(0, len(m), 1 << 15):
                s, t = m[at : at + (1 << 15)], n[at : at + (1 << 15)]
                near = np.einsum("ij,ij->i", unit[s], unit[t]) >= threshold
                s, t = s[near], t[near]
                np.add.at(links, s, mult[t])
                np.add.at(links, t, mult[s])
                groups.join(s, t)
    return links, groups.root


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; a component is named by its smallest key."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0, at most 1")
    single = rows.schema[vector].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"
    x = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vec"), F.col(label).alias("label"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda c: c != 0), F.lit(False))
    classes = x.where(usable).groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))

    # Tiles: a label's vectors by the signs of some components, then by hash where those are many.
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("tile", F.greatest(F.lit(tile), F.least(F.lit(TILE_MOST), F.sqrt(F.col("n") * TILE_ROOT).cast("int"))))
    bits = F.least(F.lit(16), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n") / F.col("tile")))).cast("int"))
    signs = F.aggregate(F.sequence(F.lit(1), F.least(F.col("bits"), F.col("dim"))), F.lit(0), lambda code, k: code * 2 + (F.get("vec", k - 1) > 0).cast("int"))
    signed = classes.join(sizes.withColumn("bits", bits), ["label", "dim"]).withColumn("code", F.when(F.col("bits") > 0, signs).otherwise(0))
    cells = signed.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("in_code"))
    dealt = signed.join(cells, ["label", "dim", "code"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_code") / F.col("tile"))))
    tiles = dealt.groupBy("label", "dim", "code", "salt").agg(F.count(F.lit(1)).alias("in_tile"))
    # A tile's number: its rank among the label's tiles, of which there are few.
    over = Window.partitionBy("label", "dim")
    tiles = tiles.withColumn("i", F.row_number().over(over.orderBy("code", "salt")) - 1).withColumn("tiles", F.count(F.lit(1)).over(over))
    whole_type = T.StructType([T.StructField("label", rows.schema[label].dataType), *T._parse_datatype_string("dim int, i long, n long, node array<long>, mult array<long>, low array<double>, high array<double>, vec binary").fields])

    def as_row(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        values = pa.concat_arrays([c.flatten() for c in group["vec"].chunks]).to_numpy().astype(kind)
        unit = unit_rows(values.reshape(group.num_rows, -1))
        wrap = lambda found, t: pa.array([found], pa.list_(t))
        lists = [wrap(group[name].to_pylist(), pa.int64()) for name in ("node", "mult")]
        boxes = [wrap(x, pa.float64()) for x in (unit.min(axis=0), unit.max(axis=0))]
        return pa.Table.from_arrays([first["label"], first["dim"], first["i"], first["tiles"], *lists, *boxes, pa.array([values.tobytes()], pa.binary())], names=whole_type.names)

    members = dealt.join(tiles, ["label", "dim", "code", "salt"]).select("label", "dim", F.col("i").cast("long").alias("i"), F.col("tiles").cast("long").alias("tiles"), "node", "mult", "vec")
    whole = cut(members.groupBy("label", "dim", "i").applyInArrow(as_row, whole_type))
    # Boxes of each tile and each that follows it; then the vectors of the pairs that can link.
    box = whole.select("label", "dim", "i", "low", "high")
    gap = F.aggregate(F.arrays_zip("low", "high", "low2", "high2"), F.lit(0.0), lambda s, b: s + F.pow(F.greatest(F.lit(0.0), b["low"] - b["high2"], b["low2"] - b["high"]), 2))
    later = whole.select("label", "dim", F.col("i").alias("lo"), "low", "high", F.explode(F.sequence("i", F.col("n") - 1)).alias("i"))
    near = later.join(box.withColumnsRenamed({"low": "low2", "high": "high2"}), ["label", "dim", "i"]).where(gap <= reach_of(threshold)).select("label", "dim", "lo", F.col("i").alias("hi"))
    ends = near.withColumn("i", F.explode(F.array_distinct(F.array("lo", "hi"))))
    pairs = ends.join(whole.select("label", "dim", "i", "node", "mult", "vec"), ["label", "dim", "i"])

    def compare(group: pa.Table) -> pa.Table:
        order = sorted(range(group.num_rows), key=lambda k: group["i"][k].as_py())
        dim = group["dim"][0].as_py()
        vecs = [np.frombuffer(group["vec"][k].as_buffer(), dtype=kind).reshape(-1, dim) for k in order]
        mults = [np.array(group["mult"][k].as_py()) for k in order]
        nodes = np.concatenate([np.array(group["node"][k].as_py()) for k in order])
        links, root = compare_tiles(vecs[0], vecs[1] if len(vecs) > 1 else None, mults[0], mults[1] if len(mults) > 1 else None, threshold)
        met = links > 0
        return pa.table({"node": nodes[met], "links": links[met], "root": nodes[root[met]]})

    met = cut(pairs.groupBy("label", "dim", "lo", "hi").applyInArrow(compare, "node long, links long, root long"))
    found = components(met, "node", "root")
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(counted, "node", "left").join(found, "node", "left").select("label", "vec", "mult", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "vec", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component_id")
    # The rows that can link, with their class; the others stand alone.
    linked = x.where(usable).join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = x.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

"""Connected components of a graph whose links no single machine has to hold.

Links met in one task are first joined by a local union-find, which leaves at most one row for
each node and task. Rounds of large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) then turn the graph into stars around the smallest node;
each round is cut by a checkpoint, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import cut


class Forest:
    """Union-find with the smallest member as the root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in stream:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = [x for x in forest.parent if forest.find(x) != x]
    yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([forest.find(x) for x in nodes], pa.int64())})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large: each node's larger neighbours go to the smallest of its
    neighbourhood. Small: so do its smaller neighbours and the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node bigint, component bigint) of every node of ``links``; the component is its smallest node.

    Links may repeat, stand in either order, or join a node with itself; those with a null are left
    out. A node that only links to itself has no row.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = cut(pairs.mapInArrow(_contract, "a long, b long").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        now = cut(_star(_star(now, True), False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` slots, which never change. Bytes are added up for each slot, and a
map from slots to shards is stored with a version; rebalancing, or adding a shard, stores a new
version that moves as few slots as it takes. A slot that holds more than one part in ``PIECES`` of a
shard's due, of bytes or of rows (as when one record is repeated over and over), is mapped in
pieces, into which its rows are dealt by where they stand in the table. The driver handles one row
for each piece, SLOTS + 2 * PIECES * shards at most, however many records there are.

The law held is ``bytes``: the shards' sizes are near equal. Version 0 deals the slots in turn;
version 1 moves slots from the fullest to the emptiest shard while that evens them out.

A record's place in its shard is gapless from 0: the pieces of a shard follow each other, and no task
ranks more than a piece. Slots do not depend on how the table is split into files; places, and the
pieces of large slots, do.

Cases: a null text has size 8 and CRC 0; repeated rows each keep a row and a place, and even out
like others; null keys are hashed with the text; a single record larger than a shard's due fills its
shard alone; other columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import cut, scratch_path

SLOTS, PIECES = 4096, 64


def rebalance(slot_bytes: list[int], shard_of: list[int], shards: int) -> list[int]:
    """An edited map: slots move from the fullest shard to the emptiest, each time the slot that
    evens the two best, until no move does."""
    shard_of = list(shard_of)
    load = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        members[shard].add(slot)
    while True:
        low = min(range(shards), key=lambda s: (load[s], s))
        # The fullest shard that can still give: one that a single large slot fills cannot.
        for full in sorted(range(shards), key=lambda s: (-load[s], s)):
            gap = load[full] - load[low]
            able = [s for s in members[full] if 0 < slot_bytes[s] < gap]
            if able:
                break
        else:
            return shard_of
        slot = min(able, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
        members[full].remove(slot)
        members[low].add(slot)
        load[full] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
        shard_of[slot] = low


def grow(slot_bytes: list[int], shard_of: list[int], shards: int) -> list[int]:
    """A map for one more shard, which takes slots from the fullest shards; no other slot moves."""
    shard_of = [*shard_of]
    load = [0] * (shards + 1)
    members: list[set[int]] = [set() for _ in range(shards + 1)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        members[shard].add(slot)
    share = sum(load) / (shards + 1)
    while True:
        full = max(range(shards), key=lambda s: (load[s], -s))
        able = [s for s in members[full] if 0 < slot_bytes[s] and load[shards] + slot_bytes[s] <= max(share, slot_bytes[s] if not load[shards] else 0)]
        if not able or load[full] <= share:
            return shard_of
        slot = max(able, key=lambda s: (slot_bytes[s], -s))
        members[full].remove(slot)
        load[full] -= slot_bytes[slot]
        load[shards] += slot_bytes[slot]
        shard_of[slot] = shards


def store_map(spark: SparkSession, path: str, version: int, pieces: list[tuple[int, int]], shard_of: list[int]) -> None:
    """Adds a version to the map stored at ``path``."""
    rows = spark.createDataFrame([(*piece, shard) for piece, shard in zip(pieces, shard_of, strict=True)], "slot int, piece int, shard int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").select("slot", "piece", "shard")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, piece) of every row; ``slot`` is
    the row's place in its shard. The map's versions 0 and 1 are stored at ``map_path`` (a new folder;
    by default one below the shared folder)."""
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, "slot-map")
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    x = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    x = x.withColumn("virtual_slot", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(slots)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    x = cut(x)
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")]

    found = x.groupBy("virtual_slot").agg(*sums).collect()  # one row for each slot
    due = [sum(r[c] for r in found) / (shards * PIECES) for c in ("bytes", "n")]
    large = [(r["virtual_slot"], max(math.ceil(r["bytes"] / due[0]), math.ceil(r["n"] / due[1]))) for r in found]
    into = F.broadcast(spark.createDataFrame([(s, n) for s, n in large if n > 1], "virtual_slot int, pieces int"))
    x = x.join(into, "virtual_slot", "left").withColumn("piece", F.pmod("row", F.coalesce("pieces", F.lit(1))).cast("int"))

    held = cut(x.groupBy("virtual_slot", "piece").agg(*sums))
    size_of = {(r["virtual_slot"], r["piece"]): r["bytes"] for r in held.collect()}
    pieces = sorted({(s, 0) for s in range(slots)} | size_of.keys())
    first = [k % shards for k in range(len(pieces))]
    store_map(spark, path, 0, pieces, first)
    store_map(spark, path, 1, pieces, rebalance([size_of.get(p, 0) for p in pieces], first, shards))

    # The pieces' first places run through each shard.
    order = Window.partitionBy("shard").orderBy("virtual_slot", "piece")
    starts = held.join(F.broadcast(load_map(spark, path, 1).withColumnRenamed("slot", "virtual_slot")), ["virtual_slot", "piece"])
    starts = starts.withColumn("start", F.sum("n").over(order) - F.col("n")).select("virtual_slot", "piece", "shard", "start")
    place = F.row_number().over(Window.partitionBy("virtual_slot", "piece").orderBy("key", "text_crc32", "size", "row"))
    placed = x.withColumn("place", place).join(F.broadcast(starts), ["virtual_slot", "piece"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "piece")

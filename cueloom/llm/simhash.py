"""SimHash fingerprints and their links by bit-sliced comparison.

Fingerprints within ``RADIUS`` = 2 bits agree in at least two of their four 16-bit words, so each
distinct fingerprint goes to the six buckets of its pairs of words. A bucket is compared bit-sliced:
bit planes are stored vertically, one machine word holding one bit of 64 fingerprints, the
differences are added up by carry-save counters for all of them at once, and a block is abandoned
when all of it has passed the radius. A bucket of more than ``BUCKET`` fingerprints is dealt anew by
pairs of bytes of its other 32 bits; what then meets agrees in 48 bits, so it is 65,536 at most.

Exact copies share a fingerprint and are compared once. Linked fingerprints of a bucket leave it as
stars, never as all pairs, and ``components`` joins the stars.

Cases: null, empty or blank texts have fingerprint zero, which links like any other; fewer words
than a shingle are one shingle; repeated rows each keep a row; a row with a null key takes part and
gets its group's smallest key (null if there is none); other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut, shuffle_partitions, small_batches
from cueloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that a bucket may hold before it is dealt anew.
BUCKET = 4096
#: Machine words that the counters of one step of a comparison hold.
STEP_WORDS = 1 << 15


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the words, A-Z in lower case, as unsigned integers."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype=np.uint64, count=max(1, len(words) - size + 1))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint) of every row: the 64 bits as a signed integer."""
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType

    def one(item: pa.BinaryScalar) -> int:
        value = item.as_py()
        return fingerprint_of(shingle_hashes(value)) if value else 0

    def each(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            bits = np.array([one(x) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[key, "fp"])

    schema = T.StructType([T.StructField(key, key_type), T.StructField("fp", T.LongType())])
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(each, schema)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all values, 64 values to a machine word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(values) // 64) * 64), dtype=np.uint8)
    padded[:, : len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A row of machine words for each query, with a bit for each value in the radius.

    bits: those in which values can differ.
    """
    shape = (len(queries), planes.shape[1])
    ones, twos, dead = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    for k, b in enumerate(bits):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        differs = planes[b][None, :] ^ flip[:, None]
        carry = ones & differs
        ones ^= differs
        dead |= twos & carry  # four or more
        twos ^= carry
        dead |= ones & twos  # three; stays dead whatever the counters do next
        if k % 4 == 3 and not (~dead).any():
            break
    return ~dead


def stars(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first of its group) of the groups that distinct values form in the radius."""
    values = np.sort(values)
    n = len(values)
    varying = np.flatnonzero(np.unpackbits(np.array([np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values)], dtype="<u8").view(np.uint8), bitorder="little"))
    planes = bit_planes(values)
    left = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view("<u8")
    seen = np.zeros(n, dtype=bool)
    members, firsts = [], []
    step = max(1, STEP_WORDS // planes.shape[1])
    # Small buckets: all rows at once. Otherwise row by row, as groups are explored.
    rows = within(planes, values, varying) if n <= step else None
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        left[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        todo = np.array([first])
        while len(todo):
            near = np.zeros(planes.shape[1], dtype=np.uint64)
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                near |= np.bitwise_or.reduce(rows[part] if rows is not None else within(planes, values[part], varying), axis=0)
            near &= left
            left &= ~near
            todo = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            seen[todo] = True
            members.append(values[todo])
            firsts.append(np.repeat(values[first : first + 1], len(todo)))
    return np.concatenate(members), np.concatenate(firsts)


def _compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket columns, fp) in the order of the buckets: links of each bucket's stars."""
    held: tuple | None = None

    def bucket_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1), batch.columns[-1].to_numpy()

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fps)]])
        found = [stars(fps[a:b].view(np.uint64)) for a, b in zip(starts, ends, strict=True) if b - a > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in stream:
        if not batch.num_rows:
            continue
        keys, fps = bucket_of(batch)
        if held:
            keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
        same = (keys == keys[-1]).all(axis=1)
        last = len(fps) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield from links(keys[:last], fps[:last])
        held = keys[last:], fps[last:]
    if held:
        yield from links(*held)


def _met(rows: DataFrame, *bucket: str) -> DataFrame:
    """Links of the rows of each bucket."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.select(*bucket, "fp").repartition(parts, *bucket).sortWithinPartitions(*bucket).mapInArrow(_compare, "a long, b long")


def linked(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints of column fp into their groups."""
    def pair_key(width: int, base: int, i: int, j: int):
        word = lambda k: F.shiftrightunsigned("fp", base + width * k).bitwiseAND((1 << width) - 1)
        return F.shiftleft(word(j), width).bitwiseOR(word(i))

    pairs = list(combinations(range(4), 2))
    coarse = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(n).alias("t"), pair_key(16, 0, *p).alias("k")) for n, p in enumerate(pairs)))).alias("x")).select("fp", "x.t", "x.k")
    counts = coarse.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = cut(coarse.join(counts, ["t", "k"]))
    # The bytes of the two words that are not in the key: each word has two, which makes four.
    others = {n: [byte for w in range(4) if w not in p for byte in (2 * w, 2 * w + 1)] for n, p in enumerate(pairs)}
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    again = F.when(F.lit(False), F.lit(None))
    for n, own in others.items():
        again = again.when(F.col("t") == n, F.array(*(F.struct(F.lit(m).alias("u"), F.shiftleft(byte(own[j]), 8).bitwiseOR(byte(own[i])).alias("v")) for m, (i, j) in enumerate(pairs))))
    fine = rows.where(F.col("n") > bucket).withColumn("x", F.explode(again)).select("t", "k", "x.u", "x.v", "fp")
    return _met(rows.where(F.col("n") <= bucket), "t", "k").unionByName(_met(fine, "t", "k", "u", "v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint string, component_id) of every row; the component is named by its smallest key."""
    each = cut(fingerprints(docs, key, text))
    distinct = each.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(linked(distinct, bucket))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = named.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(groups, "fp").select(F.col(key), hexed.alias("fingerprint"), "component_id")

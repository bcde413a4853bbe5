"""Benchmark decontamination with an FM-index per training shard.

A task gathers whole documents into shards of about ``SHARD_WORDS`` words, and indexes each shard:
words become symbols, the suffixes are sorted by prefix doubling, and the Burrows-Wheeler transform
is kept as a wavelet matrix, whose ranks drive the backward search of all windows of the benchmark
at once. Occurrences are located from sampled suffix positions and merged into spans to remove.
No document leaves its task, so there is no shuffle and no key to be skewed.

The alphabet is that of the benchmark: a word that no window has cannot be inside an occurrence, so
it only separates. Runs of benchmark words that are shorter than the shortest window hold no
occurrence and are not indexed; nothing else is left out.

The benchmark is broadcast in chunks of at most ``CHUNK_BYTES`` of text (an item is never split, so a
larger one is a chunk of its own); each further chunk is one more pass over the documents.

Cases: null, empty or wordless texts have no words, and no hits; items without words have no
windows; an item with a null id marks hits but is not counted among the items, and items that share
an id count once; repeated documents each keep a row; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut, small_batches
from cueloom.llm.wordshuffle import gather_runs, spans

WINDOW = 13
#: Contaminated: a word in so many, or more, is hit.
SHARE = 20
SHARD_WORDS = 500_000
CHUNK_BYTES = 16_000_000
#: Every so manieth position of a run has its place stored, and the first.
SAMPLE = 8
#: Words are runs of a-z, 0-9 and what isn't ASCII, after A-Z are put in lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WaveletMatrix:
    """Ranks and symbols of a sequence of integers under 2**bits."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (now >> bit) & 1 == 1
            before = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append(before)
            self.zeros.append(len(now) - int(before[-1]))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(end), end
        for k, (before, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = before[low], before[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for before, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = before[low], before[at]
            one = before[at + 1] > b
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - low


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix ends with the next 0, and earlier 0s are smaller.

    The doubling looks again only at suffixes that are still equal.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = int(rank.max(initial=1)).bit_length()
    depth = 1
    while (depth + 1) * width <= 63 and depth < min(4, n):  # as many symbols as fit into a key
        depth += 1
    # A key holds the symbols up to the first 0; what follows it does not matter, as 0s differ.
    key, open_ = rank.copy(), symbols != 0
    for k in range(1, depth):
        key <<= width
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - k] = rank[k:]
        key[open_] |= nxt[open_]
        reach = np.zeros(n, dtype=bool)
        reach[: n - k] = symbols[k:] != 0
        open_ &= reach
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    at = np.flatnonzero(tied)  # places in the order whose suffixes are still equal to another
    while len(at):
        suffix = order[at]
        group, then = rank[suffix], rank[np.minimum(suffix + depth, n - 1)]
        again = np.lexsort((then, group))
        suffix, group, then = suffix[again], group[again], then[again]
        order[at] = suffix
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (group[1:] == group[:-1]) & (then[1:] == then[:-1])
        rank[suffix] = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        tied = same.copy()
        tied[:-1] |= same[1:]
        at, depth = at[tied], depth * 2
    return order


class ShardIndex:
    """FM-index of runs of symbols (1 and up), each ended by a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        order = sort_suffixes(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], max(1, int(n_symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        ends = np.flatnonzero(symbols == 0)
        starts = np.concatenate([[0], ends + 1])[: len(ends)]
        run_at = np.repeat(starts, ends + 1 - starts)
        sampled = (np.arange(len(symbols)) - run_at) % SAMPLE == 0
        self.is_sampled = sampled[order]
        self.nth_sample = np.cumsum(self.is_sampled) - 1
        self.samples = order[self.is_sampled]
        self.size = len(symbols)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows (rows of symbols) that occur, with the ranges of their suffixes."""
        which = np.arange(len(windows))
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.size, dtype=np.int64)
        for symbol in windows.T[::-1]:
            c = symbol[which]
            low, high = self.before[c] + self.bwt.rank(c, low), self.before[c] + self.bwt.rank(c, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes at these places of the order start."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            done = self.is_sampled[rows]
            out[left[done]] = self.samples[self.nth_sample[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol, rank = self.bwt.symbol_and_rank(rows)
            rows, steps = self.before[symbol] + rank, steps + 1
        return out


class Benchmark:
    """Distinct windows of a chunk of items, by length, over the chunk's alphabet."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.symbol: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[at : at + window]), set()).update([number[item]] if item is not None else [])
        self.groups = []  # (windows of a length, starts of their items, items)
        for length in sorted({len(w) for w in found}):
            windows = [w for w in found if len(w) == length]
            of = [sorted(found[w]) for w in windows]
            self.groups.append((np.array(windows, dtype=np.int64), spans(np.array([len(x) for x in of])), np.array([i for x in of for i in x], dtype=np.int64)))
        self.shortest = min((len(w) for w in found), default=0)


class _Symbols(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def search_shard(symbols: np.ndarray, sizes: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the shard are inside an occurrence, and distinct (document, item) pairs.

    symbols: of all words, 0 for those that the benchmark lacks; sizes: words of each document.
    """
    hit = np.zeros(len(symbols), dtype=bool)
    pairs = np.zeros((0, 2), dtype=np.int64)
    if not bench.groups or not len(symbols):
        return hit, pairs
    ends = spans(sizes)
    # Runs end at a word that the benchmark lacks and at the end of a document.
    stop = symbols == 0
    cuts = np.union1d(np.flatnonzero(stop), ends)  # a run lies between two cuts
    starts = cuts[:-1] + (stop[cuts[:-1]])
    lengths = cuts[1:] - starts
    long = lengths >= bench.shortest
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return hit, pairs
    word_at = gather_runs(starts, lengths + 1).astype(np.int64)
    indexed = symbols[np.minimum(word_at, len(symbols) - 1)].astype(np.int64)
    indexed[np.cumsum(lengths + 1) - 1] = 0
    index = ShardIndex(indexed, len(bench.symbol) + 1)
    marks = np.zeros(len(symbols) + 1, dtype=np.int64)
    found = []
    for windows, item_ends, items in bench.groups:
        which, low, high = index.search(windows)
        if not len(which):
            continue
        rows = gather_runs(low, high - low).astype(np.int64)
        window = np.repeat(which, high - low)
        at = word_at[index.locate(rows)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + windows.shape[1], -1)
        doc_window = np.unique(np.stack([np.searchsorted(ends, at, side="right") - 1, window], axis=1), axis=0)
        n = np.diff(item_ends)[doc_window[:, 1]]
        found.append(np.stack([np.repeat(doc_window[:, 0], n), items[gather_runs(item_ends[doc_window[:, 1]], n)]], axis=1))
    hit = np.cumsum(marks)[:-1] > 0
    return hit, np.unique(np.concatenate([pairs, *found]), axis=0)


def _chunks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items of the benchmark, a bounded number of bytes at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(key).cast("string").alias("i"), F.col(text).cast("string").cast("binary").alias("t")).where("t is not null").toLocalIterator():
        if held and size + len(row["t"]) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
    yield held


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, kept columns, n_words, spans, items) of every row of ``docs``.

    spans: merged runs of hit words, numbered from 0, end not included; items: ids of the items with
    occurring windows, as strings in order.
    """
    small_batches(docs.sparkSession)
    names = [key, *keep]
    # The text comes along once: as a kept column, or as one of its own that is dropped at the end.
    body = text if text in names else "_body"
    own = [] if text in names else [T.StructField(body, T.StringType())]
    schema = T.StructType([*(docs.schema[n] for n in names), *own, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    empty = [F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")]
    now = docs.select(*(F.col(f"`{n}`") for n in names), *([] if text in names else [F.col(text).cast("string").alias(body)]), *empty)
    context = docs.sparkSession.sparkContext
    own_names = [f.name for f in own]
    for nth, chunk in enumerate(_chunks(benchmark, item_key, item_text)):
        sent = context.broadcast(chunk)


        def search(stream: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value, window)
            symbol_of = _Symbols(bench.symbol).__getitem__

            def shard(batches: list[pa.RecordBatch], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                sizes = np.array([len(p) for p in parts], dtype=np.int64)
                hit, pairs = search_shard(np.concatenate(parts), sizes, bench)
                ends = spans(sizes)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                # A span also ends with its document.
                starts = np.union1d(np.flatnonzero(edge == 1), ends[:-1][(sizes > 0)][hit[ends[:-1][sizes > 0]]])
                stops = np.union1d(np.flatnonzero(edge == -1), ends[1:][(sizes > 0)][hit[ends[1:][sizes > 0] - 1]])
                span_ends = np.searchsorted(starts, ends)
                item_ends = np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1))
                at = 0
                for batch in batches:
                    n_words, spans_out, items_out = [], [], []
                    for old_spans, old_items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                        of = slice(span_ends[at], span_ends[at + 1])
                        new = list(zip((starts[of] - ends[at]).tolist(), (stops[of] - ends[at]).tolist(), strict=True))
                        items = {bench.ids[i] for i in pairs[item_ends[at] : item_ends[at + 1], 1]}
                        n_words.append(int(sizes[at]))
                        spans_out.append([{"start": a, "end": b} for a, b in merge(new + [(s["start"], s["end"]) for s in old_spans])])
                        items_out.append(sorted(items.union(old_items)))
                        at += 1
                    columns = [*batch.columns[: len(names) + len(own_names)], pa.array(n_words, pa.int64()), pa.array(spans_out, _SPANS), pa.array(items_out, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

            held, parts, size = [], [], 0
            for batch in stream:
                for item in batch.column(body):
                    words = words_of(item.as_buffer().to_pybytes()) if item.is_valid else []
                    parts.append(np.fromiter(map(symbol_of, words), dtype=np.int32, count=len(words)))
                    size += len(words)
                held.append(batch)
                if size >= shard_words:
                    yield from shard(held, parts)
                    held, parts, size = [], [], 0
            if held:
                yield from shard(held, parts)

        now = (cut(now) if nth else now).mapInArrow(search, schema)
    return now.drop(*own_names)


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with its texts less the spans, from the first byte of a span's first word to the last of
    its last. A text without spans stays as it is."""
    at, spans_at, schema = found.columns.index(text), found.columns.index("spans"), found.schema

    def left(item: str | None, runs: list[dict]) -> str | None:
        if item is None or not runs:
            return item
        raw = item.encode()
        words = [m.span() for m in _WORD.finditer(raw)]
        edges = [0, *(e for run in runs for e in (words[run["start"]][0], words[run["end"] - 1][1])), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()

    def each(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = list(batch.columns)
            columns[at] = pa.array(map(left, columns[at].to_pylist(), columns[spans_at].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(each, schema)


def verdicts(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``found`` with n_hit, n_items, items_sha256 and contaminated in the place of spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("spans", "items")

"""The global distinct-word shuffle behind encoding, token counts and word statistics.

Documents are cut into blocks of bounded size. A block's words are exploded with their positions;
the positions stay together in the block's head, as the number of the word at each, and each
distinct word leaves the block once, so a word that fills a third of the corpus weighs no more than
another. The words of a block are dealt by hash into parts; all cells of a part meet in one task,
which sees every distinct word of its part however many blocks use it, works out its result once,
and sends it back to the blocks, where the results are joined to the words and put in place by
position.

A cell holds whole columns (words, counts) as compressed bytes: the shuffles carry one row for each
block and part instead of one for each word.

Blocks are numbered by task and place in the task, so the input has to be one that reads the same
way twice: a file scan or a checkpoint, not the unordered output of another shuffle.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cueloom.llm.common import shuffle_partitions, small_batches

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Parts of the words for each shuffle partition.
PARTS_PER_PARTITION = 2


class Interner(dict):
    """Numbers keys from 0 in the order in which they first come; ``order`` lists them."""

    def __init__(self) -> None:
        self.order: list = []

    def __missing__(self, key: Any) -> int:
        self[key] = n = len(self)
        self.order.append(key)
        return n


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers with their low bytes first, then the next bytes, and so on: the
    high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: memoryview | bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8, count=4 * n).reshape(4, n).T.copy().view("<u4").reshape(n)


def pack(arrays: Iterable[np.ndarray], blob: bytes = b"") -> bytes:
    """Integer columns and one run of bytes as a compressed cell."""
    arrays = list(arrays)
    head = struct.pack(f"<{len(arrays) + 1}I", len(arrays), *map(len, arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(planes, arrays)) + blob)


def unpack(cell: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(cell)
    (k,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{k}I", data, 4)
    at, out, view = 4 + 4 * k, [], memoryview(data)
    for n in sizes:
        out.append(unplanes(view[at : at + 4 * n], n))
        at += 4 * n
    return out, data[at:]


def spans(lengths: np.ndarray) -> np.ndarray:
    """Starts of runs of these lengths, with the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after the other."""
    ends = spans(lengths)
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    out = np.arange(ends[-1], dtype=kind)
    out += np.repeat((starts - ends[:-1]).astype(kind), lengths)
    return out


class Block:
    """Documents gathered until they reach the block's size.

    split(text) gives a text's chunks as hashable keys; words(key) gives the words, as bytes, that a
    chunk stands for, or None if it doesn't stand alone, in which case the key whole(text) stands for
    the text. Chunks are cut up once for each block; without ``words`` they are words. A null text is read as ``null``; where that is
    None, null and empty texts have no chunks.
    """

    def __init__(self, split: Callable[[Any], list], words: Callable[[Any], list[bytes] | None] | None, whole: Callable[[Any], Any] | None = None, null: Any = None) -> None:
        self.split, self.words, self.whole, self.null = split, words, whole, null
        self.chunks, self.names = Interner(), Interner()
        self.flat: list[int] = []  # words of the chunks, chunk after chunk
        self.sizes: list[int] = []
        self.odd: set[int] = set()  # chunks that don't stand alone
        self.docs: list[np.ndarray] = []
        self.rows: list[Any] = []
        self.chars = 0

    def _codes(self, keys: list) -> np.ndarray:
        if self.words is None:
            return np.fromiter(map(self.names.__getitem__, keys), dtype=np.int32, count=len(keys))
        known, name = len(self.chunks), self.names.__getitem__
        codes = np.fromiter(map(self.chunks.__getitem__, keys), dtype=np.int32, count=len(keys))
        for code, key in enumerate(self.chunks.order[known:], known):
            words = self.words(key)
            if words is None:
                self.odd.add(code)
                words = []
            self.flat += map(name, words)
            self.sizes.append(len(words))
        return codes

    def add(self, row: Any, text: Any) -> None:
        text = self.null if text is None else text
        codes = self._codes(self.split(text) if text or self.null is not None else [])
        if self.odd and not self.odd.isdisjoint(codes.tolist()):
            codes = self._codes([self.whole(text)])
        self.docs.append(codes)
        self.rows.append(row)
        self.chars += len(text) if text else 0

    def full(self, chars: int) -> bool:
        return self.chars >= chars or len(self.rows) >= 1 << 17

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The word of each position, and the number of positions of each document. Ends the block: what
        is known of chunks is let go."""
        if self.words is None:
            return np.concatenate([np.zeros(0, np.int32), *self.docs]), np.array([len(d) for d in self.docs], dtype=np.int64)
        self.chunks.clear()
        self.chunks.order.clear()
        sizes, flat = np.array(self.sizes, dtype=np.int32), np.array(self.flat, dtype=np.int32)
        if not len(flat):
            return flat, np.zeros(len(self.docs), dtype=np.int64)
        starts = spans(sizes)[:-1].astype(np.int32)
        chunks = np.concatenate(self.docs)
        per_chunk = sizes[chunks]
        ends = spans(per_chunk)[spans(np.array([len(d) for d in self.docs]))]
        return flat[gather_runs(starts[chunks], per_chunk)], np.diff(ends)


#: A row: the block's head (its positions) or the words of a part.
CELL = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("cell", T.BinaryType())]
)
CELL_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("head", pa.bool_()), ("cell", pa.binary())])


def block_cells(block: Block, number: int, parts: int, columns: Callable[[np.ndarray, np.ndarray], list[np.ndarray]] | None = None) -> Iterator[tuple]:
    """Rows (part, block, head, cell) of a block.

    A head has the documents' sizes and a symbol for each position: 0 where a word comes for the
    first time, else 1 more than its rank by order of frequency. The order of the words, and so what a symbol
    means, follows from each word's part and the bits of its frequency, which the head lists by
    first place. columns(codes, sizes) gives more columns for the words, by code.
    """
    codes, sizes = block.tokens()
    n = len(codes)
    first = np.full(len(block.names), n, dtype=np.int32)
    first[codes[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
    by_first = np.argsort(first, kind="stable")[: int((first < n).sum())]  # without the words of odd chunks
    counts = np.bincount(codes, minlength=len(first))[by_first]
    words = [block.names.order[i] for i in by_first.tolist()]
    where = np.fromiter((zlib.crc32(w) % parts for w in words), dtype=np.int32, count=len(words))
    bits = np.log2(np.maximum(counts, 1)).astype(np.int32)
    rank = np.empty(len(first), dtype=np.int32)
    rank[by_first[by_frequency(bits)]] = np.arange(1, len(words) + 1, dtype=np.int32)
    symbols = rank[codes]
    symbols[first[by_first]] = 0
    more = [c[by_first] for c in columns(codes, sizes)] if columns else []
    yield ((number >> 32) + number) % parts, number, True, pack([sizes, where, bits, symbols])
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        names = [words[i] for i in own.tolist()]
        yield p, number, False, pack([np.array([len(w) for w in names]), *(c[own] for c in more)], b"".join(names))


def by_frequency(bits: np.ndarray) -> np.ndarray:
    """Words, given by first place, from the most frequent: by the bits of their frequency."""
    return np.argsort(-bits, kind="stable")


def read_head(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sizes, and the word at each position: its number in the block's other cells."""
    (sizes, where, bits, symbols), _ = unpack(cell)
    number = np.empty(len(where), dtype=np.int32)
    number[np.argsort(where, kind="stable")] = np.arange(len(where), dtype=np.int32)
    ranked = number[by_frequency(bits.astype(np.int32))]
    fresh = symbols == 0
    word = np.concatenate([np.zeros(1, np.int32), ranked])[symbols]
    word[fresh] = number
    return sizes, word


def read_words(lengths: np.ndarray, blob: bytes) -> list[bytes]:
    ends = spans(lengths).tolist()
    return [blob[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def explode(stream: Iterator[pa.RecordBatch], make_block: Callable[[], Block], block_chars: int, cells: Callable[[Block, int], Iterator[tuple]]) -> Iterator[tuple]:
    """Rows of the cells of each block of a task; a batch's last column is the text, the others are
    kept in the block's rows."""
    number, block = TaskContext.get().partitionId() << 32, make_block()
    for batch in stream:
        *others, text = batch.columns
        keys = zip(*(c.to_pylist() for c in others), strict=True) if others else ((),) * batch.num_rows
        for row, item in zip(keys, text, strict=True):
            block.add(row, item.as_py())
            if block.full(block_chars):
                yield from cells(block, number)
                number, block = number + 1, make_block()
    if block.rows:
        yield from cells(block, number)


def parts_of(df: DataFrame) -> int:
    return PARTS_PER_PARTITION * shuffle_partitions(df.sparkSession)


def by_part(cells: DataFrame) -> DataFrame:
    """Cells with those of a part in one partition, and as many parts in each."""
    return cells.repartitionById(shuffle_partitions(cells.sparkSession), F.col("part"))


def row_types(docs: T.StructType) -> tuple[T.StructType, pa.Schema, pa.DataType]:
    """The types of cells whose heads carry all columns of ``docs`` but the last, the text."""
    own = T.StructType(docs.fields[:-1])
    rows = T.ArrayType(own)
    arrow = to_arrow_type(rows)
    return T.StructType([*CELL.fields, T.StructField("rows", rows)]), pa.schema([*CELL_ARROW, pa.field("rows", arrow)]), arrow.value_type


def to_cells(docs: DataFrame, make_block: Callable[[], Block], columns: Callable | None = None, block_chars: int = BLOCK_CHARS, parts: int | None = None, before: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Cells of ``docs``, whose last column is the text.

    columns(block, codes, sizes): more columns for the words of a block. before(batches): what the
    batches become before they are cut into blocks, of the columns of ``schema``.
    """
    small_batches(docs.sparkSession)
    own = schema or docs.schema
    schema, arrow, _ = row_types(own)
    names, parts = own.names[:-1], parts or parts_of(docs)

    def cells_of(block: Block, number: int) -> Iterator[tuple]:
        more = (lambda codes, sizes: columns(block, codes, sizes)) if columns else None
        for part, at, head, cell in block_cells(block, number, parts, more):
            yield part, at, head, cell, [dict(zip(names, row, strict=True)) for row in block.rows] if head else None

    return docs.mapInArrow(lambda stream: batches(explode(before(stream) if before else stream, make_block, block_chars, cells_of), arrow), schema)


def join_back(worked: DataFrame, finish: Callable[[pa.StructArray, np.ndarray, np.ndarray, list[np.ndarray]], pa.Table], schema: T.StructType) -> DataFrame:
    """Blocks put together again from their cells, after work on the words.

    finish(rows, sizes, word, columns) gets the documents' columns and sizes, the number of the word
    at each position, and the columns of the work on all words, one after the other.
    """
    kind = to_arrow_type(worked.schema["rows"].dataType).value_type

    def together(group: pa.Table) -> pa.Table:
        (head, rows), *cells = in_order(group, "cell", "rows")
        sizes, word = read_head(head)
        found = [unpack(cell)[0] for cell, _ in cells]
        return finish(pa.array(rows, kind), sizes, word, [np.concatenate(c) for c in zip(*found, strict=True)])

    return worked.groupBy("block").applyInArrow(together, schema)


def each_word(cells: DataFrame, work: Callable[[], Callable[[list[bytes], list[np.ndarray]], list[np.ndarray]]]) -> DataFrame:
    """Cells whose words have been given to work()(words, columns), which gives columns of results.

    work() is called once for each task and can keep what it knows about words.
    """
    arrow = row_types_of(cells)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            results = work()
            for batch in stream:
                for part, at, head, cell, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not head:
                        (lengths, *columns), blob = unpack(cell)
                        cell = pack(results(read_words(lengths, blob), columns))
                    yield part, at, head, cell, own

        return batches(rows(), arrow)

    return by_part(cells).mapInArrow(run, cells.schema)


def row_types_of(cells: DataFrame) -> pa.Schema:
    return pa.schema([*CELL_ARROW, pa.field("rows", to_arrow_type(cells.schema["rows"].dataType))])


def in_order(group: pa.Table, *columns: str) -> list[tuple]:
    """Rows of a block's table by rising part, the head first."""
    rows = list(zip(*(group[c].to_pylist() for c in ("head", "part", *columns)), strict=True))
    return [row[2:] for row in sorted(rows, key=lambda row: (not row[0], row[1]))]

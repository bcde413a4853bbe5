"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Every text is cut into pre-tokens by the pattern, the pre-tokens are exploded with their positions,
each distinct pre-token of the corpus is encoded once, and its ids are joined back to all its
occurrences and put in place by position (see ``wordshuffle``). Decoding joins every id to the
token-byte table, which the vocabulary bounds (about 50,000 rows, under 1 MB): the table is sent to
each worker once and looked up there, which is a broadcast join without rows of their own for ids.

Cases: a null or empty text has no ids; null ids decode to null bytes; ids that the vocabulary lacks,
and null ids in a list, decode to U+FFFD; repeated rows and null or repeated keys each keep a row of
their own; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm import wordshuffle as ws

#: Pre-tokens whose ids a task remembers; beyond it starts anew.
KNOWN = 1_000_000


@lru_cache(maxsize=2)
def load_ranks(name: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a .tiktoken file that the driver has sent with addFile."""
    with open(SparkFiles.get(name), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def load_encoder(name: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(name), special_tokens={})


def send_ranks(df: DataFrame, path: str) -> str:
    """Ships the vocabulary file to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


class Pretokens:
    """Cuts texts by the pattern, looking at each distinct run between spaces once.

    A run that follows a single space and has no white space at its ends is cut the same way
    wherever it stands. A text with other runs is cut as a whole.
    """

    def __init__(self, pattern: str) -> None:
        self.find = regex.compile(pattern).findall

    def whole(self, text: str) -> bytes:
        return text.encode()

    def split(self, text: str) -> list:
        first, *runs = text.split(" ")
        if runs and (not first or first[-1].isspace()):
            return [text.encode()]
        return [first.encode(), *runs]

    def words(self, key: str | bytes) -> list[bytes] | None:
        if isinstance(key, bytes):
            return [w.encode() for w in self.find(key.decode())]
        if not key or key[0].isspace() or key[-1].isspace():
            return None
        return [w.encode() for w in self.find(f" {key}")]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", block_chars: int = ws.BLOCK_CHARS) -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``, as tiktoken's encode_ordinary would give."""
    name = send_ranks(docs, ranks_path)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def block() -> ws.Block:
        cut = Pretokens(pattern)
        return ws.Block(cut.split, cut.words, cut.whole)

    def work() -> Callable[[list[bytes], list[np.ndarray]], list[np.ndarray]]:
        one = load_encoder(name, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}

        def ids_of(words: list[bytes], _: list[np.ndarray]) -> list[np.ndarray]:
            if len(known) > KNOWN:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = one(word)
            ids = [known[word] for word in words]
            return [np.array([len(x) for x in ids]), np.array([i for x in ids for i in x])]

        return ids_of

    def finish(rows: pa.StructArray, sizes: np.ndarray, word: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        each, flat = (c.astype(np.int32) for c in columns or [np.zeros(0), np.zeros(0)])
        sizes_at = each[word]
        values = flat[ws.gather_runs(ws.spans(each)[:-1][word], sizes_at)]
        offsets = ws.spans(sizes_at)[ws.spans(sizes)].astype(np.int32)
        return pa.table([rows.field(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=schema.names)

    cells = ws.to_cells(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), block, block_chars=block_chars)
    return ws.join_back(ws.each_word(cells, work), finish, schema)


def byte_table(name: str) -> list[bytes]:
    """Token bytes by id."""
    ranks = load_ranks(name)
    out = [b"\xef\xbf\xbd"] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        out[rank] = word
    return out


class Decoder(dict):
    """The token-byte table, and U+FFFD for ids that it lacks."""

    def __init__(self, name: str) -> None:
        super().__init__(enumerate(byte_table(name)))

    def __missing__(self, token: int) -> bytes:
        return b"\xef\xbf\xbd"

    def join(self, ids: pa.ListScalar) -> bytes | None:
        return b"".join(map(self.__getitem__, ids.values.fill_null(-1).to_numpy().tolist())) if ids.is_valid else None


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ``ids`` column in ``out`` (replaced if it is there already)."""
    name = send_ranks(df, ranks_path)
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    at = [f.name for f in kept].index(ids)

    def join_bytes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(name)
        for batch in stream:
            decoded = pa.array([table.join(x) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(join_bytes, schema)


def digests(df: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded rows; decodes as it goes, so that the
    decoded bytes stay in the task."""
    name = send_ranks(df, ranks_path)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(name)
        for batch in stream:
            n, of_ids, of_bytes = [], [], []
            for ids in batch.column(1):
                n.append(len(ids))
                of_ids.append(sha256(ids.values.to_numpy().astype("<u4", copy=False)).hexdigest())
                of_bytes.append(sha256(table.join(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    return df.select(key, "ids").mapInArrow(digest, schema)

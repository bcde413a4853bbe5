"""A language model of logistic context mixing over the running text, with scores per document.

A text is spelled as its words in lower case, each with a space, then a space for its end. Each byte
is a few binary decisions along a prefix code of the bytes that follow the one before it (frequent
ones take few). Several hashed contexts predict each decision: the last three and five bytes, whatever
words they are of, and the word so far after the word before it. Their predictions are stretched and
summed with weights that a gate chooses (how many of the contexts training has seen), and the sum is
refined by an adaptive map from what came out for such sums. Weights and map are the text's own: they
start alike for every text and move while it is scored. A step, after which they move, is ``STEP`` bytes at first and grows with the
place in the text, so a text of any length takes few steps and its score depends on it alone.

What is learned covers all training rows: the code from the counts of pairs of bytes, and for each
decision in each context how often it went either way, in hashed tables of fixed size (``BITS``;
a byte a slot is broadcast, 12 MB in all: both counts where they are few, else their log odds). The tables do not
grow with the corpus; what long contexts cannot tell apart any more, shorter ones still predict, and
the weights follow. Every text is scored by the same model, so its score is the logarithm of one
probability distribution over texts. What a training row says is among the counts, as it is in those of base_score:
training rows are foreseen better than held-out ones, and only rows of one kind should be compared.

Counts of whole words, which base_score and n_known need, are exact and grow with the corpus: they
come from the distinct-word shuffle (see ``wordshuffle``).

Cases: a null or empty text is its end alone; without training rows every count is zero and each
decision even; rows with a null key are training rows; repeated rows each keep a row; other columns
are left out, whatever their names; long texts are scored in pieces of ``PIECE`` bytes at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm import wordshuffle as ws
from cueloom.llm.common import cut, small_batches

END = b" "
#: Bytes of the contexts of bytes; the last context is the word so far after the word before it.
ORDERS = (3, 5)
CONTEXTS = len(ORDERS) + 1
#: Slots of each context's table, as bits.
BITS = (22, 22, 22)
CHUNK = 1 << 17
#: Added to both counts of a context.
PRIOR, RATE = 0.02, 0.1
GATES, BUCKETS = CONTEXTS + 1, 24
#: Bytes of the first steps, steps in each doubling of the place, and the longest step.
STEP, STEPS, STEP_MOST = 32, 16, 1 << 16
#: Bytes worked on at once: of texts scored together, and of these in one piece.
AT_ONCE, PIECE = 1 << 20, 1 << 15
#: Bytes of texts whose contexts are made together: what a processor keeps near.
NEAR = 1 << 16
#: Occurrences up to which a state has both counts, the number of the first other state, and the log odds of the last.
EXACT, FIRST_ROUGH, MOST_ODDS = 14, 120, 12.0
_R, _S, _T = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then the end of the text."""
    return [*text.lower().split(), END]


_SPELLED = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5))


def spelled(text: bytes) -> bytes:
    """The tokens, each word with a space after it."""
    text = text.translate(_SPELLED).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text + b"  " if text else END


class Tokens(ws.Block):
    """A block of spelled texts, whose words are told apart all at once."""

    def __init__(self) -> None:
        super().__init__(tokens_of, None)
        self.texts: list[bytes] = []

    def add(self, row: tuple, text: bytes) -> None:
        self.texts.append(text)
        self.rows.append(row)
        self.chars += len(text)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(self.texts)
        ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32) + 1  # each token ends with its space
        offsets = np.concatenate([np.zeros(1, dtype=np.int64), ends])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, cuts, blob = coded.dictionary.buffers()
        cuts, blob = np.frombuffer(cuts, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), blob.to_pybytes()
        self.names.order = [blob[a : b - 1] or END for a, b in zip(cuts, cuts[1:], strict=False)]
        self.names.update(zip(self.names.order, range(len(self.names.order)), strict=True))
        sizes = np.diff(np.searchsorted(ends, ws.spans(np.array([len(t) for t in self.texts])), side="right"))
        self.texts = []
        return coded.indices.to_numpy(), sizes


@dataclass
class Code:
    """A prefix code of bytes for each byte before: the decisions of byte b after byte a are
    lengths[256 * a + b] entries of node and bit from starts[256 * a + b]."""

    lengths: np.ndarray
    starts: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def __post_init__(self) -> None:
        self.both = self.node.astype(np.int64) << 1 | self.bit

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        """Huffman's codes of (byte before, byte) counts."""
        paths = [path for row in counts for path in _paths(row.tolist())]
        lengths = np.array([len(p) for p in paths])
        flat = np.array([step for p in paths for step in p], dtype=np.uint8)
        return Code(lengths, ws.spans(lengths)[:-1], flat[:, 0], flat[:, 1])

    def decisions(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many decisions each byte takes, given 256 times the byte before and it; for each decision
        the place of its byte in ``pairs``, and twice its node plus its outcome."""
        n = self.lengths.take(pairs)
        ends = ws.spans(n)
        of = np.repeat(np.arange(len(pairs)), n)
        at = (self.starts.take(pairs) - ends[:-1]).take(of, mode="clip")
        at += np.arange(ends[-1])
        return n, of, self.both.take(at, mode="clip")


def _paths(counts: list[int]) -> list[tuple[tuple[int, int], ...]]:
    """The (node, bit) decisions of each byte. Nodes are numbered from the most frequent, which stand
    close in a table."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children, weight = {}, {}
    for name in range(256, 511):
        (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[name], weight[name] = (a, b), m + n
        heapq.heappush(heap, (m + n, name, name))
    number = {name: k for k, name in enumerate(sorted(children, key=lambda x: (-weight[x], -x)))}
    paths: dict[int, tuple] = {}
    todo: list[tuple[int, tuple]] = [(510, ())]
    while todo:
        name, path = todo.pop()
        if name < 256:
            paths[name] = path
        else:
            todo += [(child, (*path, (number[name], bit))) for bit, child in enumerate(children[name])]
    return [paths[b] for b in range(256)]


def _hash(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _R
    x ^= x >> np.uint64(29)
    x *= _S
    return (x >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Running:
    """Some spelled texts, one after the other."""

    lengths: np.ndarray
    pairs: np.ndarray  # 256 times the byte before (0: none) and the byte
    contexts: list[np.ndarray]  # the slot of each context before each byte

    @staticmethod
    def of(texts: list[bytes]) -> Running:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        n = int(lengths.sum())
        out = Running(lengths, np.empty(n, dtype=np.uint16), [np.empty(n, dtype=np.uint32) for _ in BITS])
        a = 0
        for some in _together(texts, NEAR):
            raw = np.frombuffer(b"".join(some), dtype=np.uint8)
            out._fill(slice(a, a + len(raw)), raw, np.array([len(t) for t in some], dtype=np.int64))
            a += len(raw)
        return out

    def _fill(self, where: slice, raw: np.ndarray, lengths: np.ndarray) -> None:
        """What is known of the bytes of some whole texts that follow each other."""
        n, starts = len(raw), ws.spans(lengths)[:-1]
        at = np.arange(n)
        # The seven bytes before, the nearest lowest, by doubling; less at the start of a text.
        last = np.zeros(n, dtype=np.uint64)
        last[1:] = raw[:-1]
        for size in (1, 2, 4):
            last[size:] |= last[:-size] << np.uint64(8 * size)
        last &= _MASKS[7]
        for size in range(7):
            last[starts[lengths > size] + size] &= _MASKS[size]
        for out, size, bits in zip(self.contexts, ORDERS, BITS, strict=False):
            out[where] = _hash(last & _MASKS[size], size << 57, bits)
        opens = np.zeros(n, dtype=bool)
        opens[1:] = raw[:-1] == 32
        starts = starts[lengths > 0]
        opens[starts] = True
        words = np.flatnonzero(opens)
        sizes = np.diff(np.append(words, n))
        into = at - np.repeat(words, sizes)
        so_far = last & _MASKS.take(np.minimum(into, 7))
        so_far ^= into.astype(np.uint64) << np.uint64(56)
        previous = so_far[words - 1]
        previous[np.searchsorted(words, starts)] = 0
        previous = _R * (previous ^ (previous >> np.uint64(32)))
        so_far *= _T
        so_far ^= np.repeat(previous, sizes)
        self.contexts[-1][where] = _hash(so_far, 1, BITS[-1])
        last &= _MASKS[1]
        last <<= np.uint64(8)
        last |= raw
        self.pairs[where] = last


_MASKS = np.array([(1 << 8 * size) - 1 for size in range(8)], dtype=np.uint64)


def count(texts: list[bytes], code: Code, tables: list[np.ndarray]) -> None:
    """Adds the decisions of spelled texts to each context's (2 * slots) counts."""
    own = Running.of(texts)
    keys = np.empty(len(own.pairs), dtype=np.int64)
    for table, context in zip(tables, own.contexts, strict=True):
        # Bytes that come again in a context are added at once, and slots in their order in the table.
        keys[:] = context
        keys <<= 16
        keys |= own.pairs
        keys.sort()
        for start in range(0, len(keys), PIECE):
            some = keys[start : start + PIECE]
            edge = np.ones(len(some) + 1, dtype=bool)
            np.not_equal(some[1:], some[:-1], out=edge[1:-1])
            edges = np.flatnonzero(edge)
            some, times = some.take(edges[:-1]), np.diff(edges).astype(table.dtype)
            _, of, low = code.decisions(some & 0xFFFF)
            # The nodes of a context stand around its slot.
            some >>= 16
            some <<= 1
            low ^= some.take(of, mode="clip")
            np.add.at(table, low, times.take(of, mode="clip"))


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each byte follows each in spelled texts; a text's first follows 0."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    pairs = raw.astype(np.uint16)
    pairs[1:] |= raw[:-1].astype(np.uint16) << 8
    first = ws.spans(np.array([len(t) for t in texts]))[:-1]
    pairs[first] = raw[first]
    return np.bincount(pairs, minlength=1 << 16)


def states_of(counts: np.ndarray) -> np.ndarray:
    """(2 * slots) counts as a byte a slot: the two counts where they are few, else their log odds."""
    zero, one = counts[::2].astype(np.int64), counts[1::2].astype(np.int64)
    total = zero + one
    few = np.minimum(total, EXACT)
    odds = np.log((one + PRIOR) / (zero + PRIOR))
    rough = FIRST_ROUGH + np.rint((np.clip(odds, -MOST_ODDS, MOST_ODDS) / MOST_ODDS + 1) * (255 - FIRST_ROUGH) / 2)
    return np.where(total <= EXACT, few * (few + 1) // 2 + one, rough).astype(np.uint8)


def stretched() -> np.ndarray:
    """For the outcomes 0 and 1, the log odds of that outcome in each state: those of 0 are the others', negated."""
    total = np.repeat(np.arange(EXACT + 1), np.arange(1, EXACT + 2))
    one = np.concatenate([np.arange(t + 1) for t in range(EXACT + 1)])
    odds = np.concatenate([np.log((one + PRIOR) / (total - one + PRIOR)), np.linspace(-MOST_ODDS, MOST_ODDS, 256 - FIRST_ROUGH)])
    return np.concatenate([-odds, odds]).astype(np.float32)


def steps_to(size: int) -> np.ndarray:
    """Places in a text at which weights move."""
    out = [0]
    while out[-1] < size:
        step = STEP
        while step < STEP_MOST and step * 2 * STEPS <= out[-1]:
            step *= 2
        out.append(out[-1] + step)
    return np.array(out)


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]  # states of the contexts' slots

    def logs(self, texts: list[bytes]) -> np.ndarray:
        """Natural logarithms of the probabilities of spelled texts.

        Texts are worked on together, step by step, each with its own weights and map.
        """
        # The longest first, so that those that go on in a step are the first ones.
        by = np.argsort([-len(t) for t in texts], kind="stable")
        running = Running.of([texts[i] for i in by.tolist()])
        lengths, starts = running.lengths, ws.spans(running.lengths)
        steps = steps_to(int(lengths.max(initial=0)))
        going = len(lengths) - np.searchsorted(lengths[::-1], steps, side="right")
        edges = going * steps + starts[-1] - starts[going]  # bytes before each step, of all texts
        odds = stretched()[256:]
        state = _State(len(texts))
        done = 0
        while done < len(steps) - 1:
            # As many steps as fit into a piece.
            until = max(done + 1, int(np.searchsorted(edges, edges[done] + PIECE, side="right")) - 1)
            froms, sizes = [], []
            for k in range(done, until):
                froms.append(starts[: going[k]] + steps[k])
                sizes.append(np.minimum(lengths[: going[k]], steps[k + 1]) - steps[k])
            runs = np.concatenate(sizes)
            at = ws.gather_runs(np.concatenate(froms), runs)
            n, of, node = self.code.decisions(running.pairs.take(at))
            sign = _SIGNS.take(node & 1, mode="clip")
            node >>= 1
            inputs = np.empty((CONTEXTS, len(node)), dtype=np.float32)
            gate = np.zeros(len(node), dtype=np.uint8)
            for x, table, context in zip(inputs, self.tables, running.contexts, strict=True):
                slot = context.take(at).astype(np.int64).take(of, mode="clip")
                slot ^= node
                met = table.take(slot, mode="clip")
                odds.take(met, out=x, mode="clip")
                gate += met != 0  # a context that training has seen, even if its counts are even
            bounds = ws.spans(n)[ws.spans(runs)]
            first = 0
            for count in going[done:until].tolist():
                own = bounds[first : first + count + 1]
                these = slice(own[0], own[-1])
                state.step(inputs[:, these], sign[these], gate[these], own - own[0])
                first += count
            done = until
        out = np.empty(len(texts))
        out[by] = state.logs
        return out


_SIGNS = np.array([-1, 1], dtype=np.float32)


class _State:
    """Weights and maps of some texts, and the logarithms of their probabilities so far."""

    def __init__(self, texts: int) -> None:
        self.logs = np.zeros(texts)
        # The contexts that training has seen share a sum a little over one.
        start = np.tile((1.1 / np.maximum(1, np.arange(GATES))).astype(np.float32), (texts, 1))
        self.weights = [start.copy() for _ in range(CONTEXTS)]
        self.moved = [np.ones_like(start) for _ in range(CONTEXTS)]
        self.shift = np.zeros((texts, BUCKETS), dtype=np.float32)
        self.shifted = np.ones_like(self.shift)

    def step(self, inputs: np.ndarray, sign: np.ndarray, gate: np.ndarray, bounds: np.ndarray) -> None:
        """Decisions of the first texts, each text's between two bounds. inputs: each context's log odds
        of outcome 1. sign: 1 where that came out, else -1."""
        starts, runs, some = bounds[:-1], np.diff(bounds), slice(len(bounds) - 1)
        # Most decisions, and all of training rows, have every context seen: a text has one weight for them.
        rare = np.flatnonzero(gate != CONTEXTS)
        text = np.repeat(np.arange(len(runs)), runs)
        place = text.take(rare) * GATES + gate.take(rare)
        rares = [x.take(rare) for x in inputs]
        mixed, apart = np.zeros(len(sign), dtype=np.float32), np.zeros(len(rare), dtype=np.float32)
        for w, x, y in zip(self.weights, inputs, rares, strict=True):
            mixed += np.repeat(w[some, CONTEXTS], runs) * x
            apart += w.take(place) * y
        mixed[rare] = apart
        # The map is odd: an outcome and its contrary add up to one.
        text *= BUCKETS
        text += np.minimum(np.abs(mixed) * 2, BUCKETS - 1).astype(np.int32)
        side = np.sign(mixed)
        mixed += side * self.shift.take(text, mode="clip")
        mixed *= sign
        np.clip(mixed, -14, 14, out=mixed)
        contrary = 1 + np.exp(-mixed)
        self.logs[some] -= np.add.reduceat(np.log(contrary), starts)
        error = 1 - 1 / contrary
        error *= sign
        side *= error
        _move(self.shift[some], self.shifted[some], np.bincount(text, weights=side, minlength=len(runs) * BUCKETS))
        apart = error.take(rare)
        error[rare] = 0
        for w, m, x, y in zip(self.weights, self.moved, inputs, rares, strict=True):
            up = np.bincount(place, weights=apart * y, minlength=len(runs) * GATES).astype(np.float32)  # integers, if there are none
            up[CONTEXTS::GATES] = np.add.reduceat(error * x, starts)
            _move(w[some], m[some], up)


def _move(values: np.ndarray, tally: np.ndarray, up: np.ndarray) -> None:
    up = up.astype(np.float32, copy=False).reshape(values.shape)
    tally += up * up
    up *= np.float32(RATE)
    up /= np.sqrt(tally)
    values += up


# What follows spreads the model over the cluster.

def _together(texts: Iterable[bytes], limit: int = AT_ONCE) -> Iterator[list[bytes]]:
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _squeezed(values: np.ndarray) -> bytes:
    """Integers with their low bytes first, then the next bytes, and so on, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _spread(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all rows of ``docs``, whose text is binary: a pass for the code, one for the tables."""
    def pairs_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for some in _together(spelled(t or b"") for batch in stream for t in batch.column(0).to_pylist()):
            total += pair_counts(some)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(range(1 << 16), pa.int32()), "n": pa.array(total)})

    found = docs.select(text).mapInArrow(pairs_of, "pair int, n long").where("n > 0").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    counts = np.zeros(1 << 16, dtype=np.int64)
    for row in found:
        counts[row["pair"]] = row["n"]
    code = Code.of(counts.reshape(256, 256))

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << bits, dtype=np.int64 if bits < 22 else np.int32) for bits in BITS]
        size = 0
        for some in _together(spelled(t or b"") for batch in stream for t in batch.column(0).to_pylist()):
            size += sum(map(len, some))
            if size > 1 << 27 and tables[-1].dtype == np.int32:  # before 32 bits could run over
                tables = [t.astype(np.int64) for t in tables]
            count(some, code, tables)
        for k, table in enumerate(tables):
            for chunk, values in enumerate(table.reshape(-1, 2 * CHUNK)):
                if values.any():
                    kind = "<i8" if int(values.max()) >= 1 << 31 else "<i4"
                    cell = kind.encode() + _squeezed(values.astype(kind))
                    yield pa.RecordBatch.from_pydict({"context": pa.array([k]), "chunk": pa.array([chunk]), "cell": pa.array([cell], pa.binary())})

    def add_up(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CHUNK, dtype=np.int64)
        for batch in group:
            for cell in batch.column("cell").to_pylist():
                total += _spread(cell[3:], cell[:3].decode())
        yield pa.RecordBatch.from_pydict({"context": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()]), "cell": pa.array([_squeezed(states_of(total))], pa.binary())})

    tables = [np.zeros(((1 << bits) // CHUNK, CHUNK), dtype=np.uint8) for bits in BITS]
    cells = docs.select(text).mapInArrow(counted, "context long, chunk long, cell binary")
    # A byte a slot in all, less what packing saves.
    for row in cells.groupBy("context", "chunk").applyInArrow(add_up, "context long, chunk long, cell binary").toLocalIterator():
        tables[row["context"]][row["chunk"]] = _spread(bytes(row["cell"]), "u1")
    return Model(code, [t.reshape(-1) for t in tables])


def send(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((model.code, [_squeezed(t) for t in model.tables]))


def with_logs(stream: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Batches, whose last column is the text, with the natural logarithm of each text's probability before
    it, and the text spelled."""
    code, tables = sent.value
    tables = [_spread(t, "u1") for t in tables]
    # One large array is looked up faster than several.
    model = Model(code, np.split(np.concatenate(tables), np.cumsum([len(t) for t in tables])[:-1]))
    for batch in stream:
        *others, text = batch.columns
        texts = [spelled(t or b"") for t in text.to_pylist()]
        found = [np.zeros(0), *map(model.logs, _together(texts))]
        yield pa.RecordBatch.from_arrays([*others, pa.array(np.concatenate(found)), pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "log", "text"])


def _halves(counts: np.ndarray) -> list[np.ndarray]:
    """64-bit counts as low and high 32 bits."""
    whole = counts.astype(np.uint64)
    return [whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32)]


def _whole(halves: list[np.ndarray]) -> np.ndarray:
    return halves[0] + halves[1] * 4294967296.0


def _merge(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Cells in the order of their parts, a part's words with their counts in the whole corpus: a row
    (block -1) of a part's tokens and distinct words in training, and each block's cell again."""
    words, cells, part = ws.Interner(), [], None

    def flush() -> Iterator[tuple]:
        if not cells:
            return
        total = np.zeros(len(words), dtype=np.int64)
        for _, _, numbers, own in cells:
            total[numbers] += own  # a block has a word once
        yield part, -1, False, ws.pack([*_halves(np.array([total.sum()])), *_halves(np.array([(total > 0).sum()]))]), None
        for at, block, numbers, _ in cells:
            yield at, block, False, ws.pack(_halves(total[numbers])), None

    for batch in stream:
        for at, block, head, cell, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != part:
                yield from flush()
                words, cells, part = ws.Interner(), [], at
            if head:
                yield at, block, head, cell, rows
                continue
            (lengths, *halves), blob = ws.unpack(cell)
            numbers = np.fromiter(map(words.__getitem__, ws.read_words(lengths, blob)), dtype=np.int32, count=len(lengths))
            cells.append((at, block, numbers, _whole(halves).astype(np.int64)))
    yield from flush()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "held_out", block_chars: int = ws.BLOCK_CHARS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    held_out: a boolean column, true for rows not to learn from. base_score is that of single tokens
    by add-one counts; both scores are logarithms to the base 10.
    """
    small_batches(docs.sparkSession)
    x = docs.select(F.col(key).alias("key"), (~F.coalesce(F.col(held_out), F.lit(False))).alias("training"), F.col(text).cast("string").cast("binary").alias("text"))
    x = x.select("key", "training", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    sent = send(x, train(x.where("training")))
    scored = x.select("key", "training", "size", F.lit(0.0).alias("log"), "text").schema

    def columns(own: ws.Block, codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        trained = np.repeat(np.array([row[1] for row in own.rows], dtype=bool), sizes)
        return _halves(np.bincount(codes[trained], minlength=len(own.names)))

    cells = ws.by_part(ws.to_cells(x, Tokens, columns, block_chars, before=lambda stream: with_logs(stream, sent), schema=scored))
    arrow = ws.row_types_of(cells)
    merged = cut(cells.sortWithinPartitions("part").mapInArrow(lambda stream: ws.batches(_merge(stream), arrow), cells.schema))

    def totals(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [ws.unpack(cell)[0] for cell in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([int(_whole(f[:2])[0]) for f in found], pa.int64()), "distinct": pa.array([int(_whole(f[2:])[0]) for f in found], pa.int64())})

    sums = merged.where("block = -1").select("cell").mapInArrow(totals, "tokens long, distinct long").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = int(sums["tokens"] or 0), int(sums["distinct"] or 0)

    out = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    kinds = (T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, k) for n, k in zip(out, kinds, strict=True))])

    def finish(rows: pa.StructArray, sizes: np.ndarray, word: np.ndarray, found: list[np.ndarray]) -> pa.Table:
        sizes = sizes.astype(np.int64)
        starts = ws.spans(sizes)[:-1]  # no document is without tokens: it has an end
        seen = _whole(found)
        base = np.add.reduceat(np.log10(seen + 1)[word], starts) - sizes * math.log10(tokens + distinct + 1)
        known = np.add.reduceat((seen > 0)[word].astype(np.int64), starts)
        log, size = rows.field(3).to_numpy(zero_copy_only=False), rows.field(2).to_numpy(zero_copy_only=False)
        held = pa.array(~rows.field(1).to_numpy(zero_copy_only=False).astype(bool))
        return pa.table([rows.field(0), held, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(log / math.log(10)), pa.array(-log / math.log(2) / np.maximum(1, size))], names=schema.names)

    return ws.join_back(merged.where("block >= 0"), finish, schema)

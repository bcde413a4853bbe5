"""Lloyd rounds over integer vectors, with bounds that are kept from round to round.

A pass maps the rows of the round before to new rows: vector, code of each part, and for each part an
upper bound of the distance to its entry and a lower bound of the distance to the second nearest. The
same pass adds up each entry's parts; these sums stand as rows of their own at the end of each task's
file, so the table that a round writes to the shared folder holds its rows and its sums from exactly
one attempt of each task, and one pass reads the vectors once. The driver holds the entries alone,
whose number and length are parameters.

Distances are squared integers, exact: as products of float64 while all of them stay below 2^53, in
int64 beyond. Bounds are roots in double precision, widened so that rounding never makes one too tight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut, drop_scratch, scratch_path

#: Largest integer component: squared distances of 2^8 such components still fit into a long.
LARGEST = 1 << 26
#: Widens bounds by more than double precision rounds off.
WIDE = 1e-12
#: Numbers that a slice of rows may take while it is compared.
SLICE = 1 << 20


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, and null for a vector that is null or holds a component that
    is null, not finite, or of which the integer is beyond LARGEST."""
    values = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST)
    return F.when(F.forall(vector, fits), values.cast("array<int>"))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x and each of book, as float64 where they fit, else int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * most**2 < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


def squared_to(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own entry."""
    gap = x.astype(np.int64) - book[code]
    return (gap * gap).sum(axis=1)


class Book:
    """The entries of one part, how far each moved in the last round, and how they lie to one another."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries.astype(np.int64)
        k = len(entries)
        moved = np.zeros(k) if before is None else np.sqrt(((self.entries - before) ** 2).sum(axis=1).astype(float)) * (1 + WIDE)
        self.moved = moved
        #: How far any other entry moved, at most.
        self.others = np.full(k, moved.max(initial=0))
        if k:
            first = int(moved.argmax())
            self.others[first] = np.delete(moved, first).max(initial=0)
        gaps = np.sqrt(squared(self.entries, self.entries).astype(float))
        self.order = gaps.argsort(axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        alone = gaps.copy()
        np.fill_diagonal(alone, np.inf)
        #: Distance from each entry to the nearest other.
        self.nearest = alone.min(axis=1, initial=np.inf)

    def scan(self, x: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (ties to the smaller number) of each row, upper and lower bound. ``among``:
        ascending numbers of the entries to compare, which have to hold the two nearest."""
        code, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
        numbers = np.arange(len(self.entries)) if among is None else among
        step = max(1, SLICE // max(len(numbers), x.shape[1], 1))
        for at in range(0, len(x), step):
            here = slice(at, at + step)
            d = squared(x[here], self.entries[numbers]).astype(float)
            best = d.argmin(axis=1)
            row = np.arange(len(d))
            code[here], upper[here] = numbers[best], np.sqrt(d[row, best]) * (1 + WIDE)
            d[row, best] = np.inf
            lower[here] = np.sqrt(d.min(axis=1)) * (1 - WIDE)
        return code, upper, lower

    def narrow(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds after the entries' moves, in place; returns the rows whose bounds, made exact on the
        upper side, do not rule out every other entry strictly."""
        upper += self.moved[code]
        upper *= 1 + WIDE
        lower -= self.others[code]
        lower -= WIDE * np.abs(lower)
        safe = np.maximum(lower, self.nearest[code] / 2 * (1 - WIDE))
        open_ = np.nonzero(~(upper < safe))[0]
        upper[open_] = np.sqrt(squared_to(x[open_], self.entries, code[open_]).astype(float)) * (1 + WIDE)
        return open_[~(upper[open_] < safe[open_])]


Search = Callable[[Book, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _pass(rows: DataFrame, keep: list[str], books: list[Book], search: Search, last: bool) -> DataFrame:
    """One assignment of all rows (columns ``keep`` and vec, from the second pass on with code and bounds),
    with the sums of each entry as rows of which ``part`` is not null."""
    known = "code" in rows.columns
    fields = [rows.schema[c] for c in keep]
    state = [] if last else [("vec", "array<int>"), ("upper", "array<double>"), ("lower", "array<double>")]
    columns = [("code", "array<int>"), ("distance", "bigint"), *state, ("part", "int"), ("entry", "int"), ("n", "bigint"), ("inertia", "bigint"), ("total", "array<bigint>")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns]])
    kinds = {"code": pa.list_(pa.int32()), "distance": pa.int64(), "vec": pa.list_(pa.int32()), "upper": pa.list_(pa.float64()), "lower": pa.list_(pa.float64())}
    kinds |= {"part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "inertia": pa.int64(), "total": pa.list_(pa.int64())}
    parts, width = len(books), books[0].entries.shape[1]

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b.entries), width), np.int64) for b in books]
        counts, inertia = ([np.zeros(len(b.entries), np.int64) for b in books] for _ in range(2))
        types = None
        for batch in stream:
            types = [batch.column(c).type for c in keep]
            if not (n := batch.num_rows):
                continue
            flat = lambda c, k: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            vec = flat("vec", parts * width)
            before = [flat(c, parts) for c in ("code", "upper", "lower")] if known else None
            code, upper, lower = np.empty((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts))
            distance = np.zeros(n, np.int64)
            for p, book in enumerate(books):
                x = vec[:, p * width : (p + 1) * width]
                if before is None:
                    c, u, v = book.scan(x)
                else:
                    c, u, v = (np.array(b[:, p]) for b in before)
                    search(book, x, c, u, v)
                code[:, p], upper[:, p], lower[:, p] = c, u, v
                own = squared_to(x, book.entries, c)
                distance += own
                np.add.at(counts[p], c, 1)
                np.add.at(inertia[p], c, own)
                order = np.argsort(c, kind="stable")
                starts = np.nonzero(np.diff(c[order], prepend=-1))[0]
                sums[p][c[order][starts]] += np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
            out = {c: batch.column(c) for c in keep} | {"code": _lists(code, pa.int32()), "distance": pa.array(distance)}
            if not last:
                out |= {"vec": batch.column("vec"), "upper": _lists(upper, pa.float64()), "lower": _lists(lower, pa.float64())}
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(n, kinds[f.name]) for f in schema], names=schema.names)
        used = [(p, e) for p in range(parts) for e in np.nonzero(counts[p])[0]]
        if used:
            m = len(used)
            out = {c: pa.nulls(m, t) for c, t in zip(keep, types, strict=True)}
            out |= {"part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32()), "n": pa.array([counts[p][e] for p, e in used])}
            out |= {"inertia": pa.array([inertia[p][e] for p, e in used]), "total": _lists(np.array([sums[p][e] for p, e in used]), pa.int64())}
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(m, kinds[f.name]) for f in schema], names=schema.names)

    return rows.select(*keep, *(["vec", "code", "upper", "lower"] if known else ["vec"])).mapInArrow(assign, schema)


def _means(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry as floor(sum / count) of its parts; one without any stays. The sums meet by entry and
    position with partial sums first, so the driver gets as many numbers as the entries have."""
    sums = table.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    found = sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    out = [b.copy() for b in books]
    for p, e, at, x, n in zip(*(found[c].to_pylist() for c in ("part", "entry", "at", "x", "n")), strict=True):
        out[p][e, at] = x // n
    return out


def cluster(rows: DataFrame, keep: list[str], books: list[np.ndarray], rounds: int, search: Search) -> tuple[DataFrame, list[np.ndarray]]:
    """Assigns and moves ``rounds`` times, then assigns once more.

    ``rows``: columns ``keep`` and vec (array<int>, as long as the parts' entries together, never null).
    Returns the last pass' table (keep, code, distance, and the sums as rows with a part) and the entries.
    Each round's table is written to the shared folder and goes once the next is there.
    """
    spark, path, before = rows.sparkSession, None, None
    for _ in range(rounds):
        now = [Book(b, None if before is None else before[p]) for p, b in enumerate(books)]
        wrote = scratch_path(spark, "lloyd")
        _pass(rows, keep, now, search, last=False).write.parquet(wrote)
        if path:
            drop_scratch(spark, path)
        path, table = wrote, spark.read.parquet(wrote)
        before, books = books, _means(table, books)
        rows = table.where("part IS NULL")
    now = [Book(b, None if before is None else before[p]) for p, b in enumerate(books)]
    done = cut(_pass(rows, keep, now, search, last=True))
    if path:
        drop_scratch(spark, path)
    return done, books

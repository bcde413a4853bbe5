"""Vector codes, centroid clustering and nearest neighbours against plain loops over all vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import centroids, lloyd, veccodes, vptrees

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def make(spark, vectors, schema=SCHEMA):
    """Rows (vec_id, embedding, label) with columns beyond them whose names clash with the operators' own."""
    return spark.createDataFrame([(*v, "x", 7) for v in vectors], schema).repartition(3)


def awkward(n, dim, seed=5):
    """Vectors near a few centres, with ties, copies, nulls and other lengths among them."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dim))
    out = [(k, (np.round((centres[k % 5] + 0.2 * draw.normal(size=dim)) * 16) / 16).tolist(), [None, 1, 2][k % 3]) for k in range(n)]
    out += [(n, out[0][1], 1), (n + 1, out[0][1], None), (0, out[0][1], 2), (n + 2, None, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [None] + [0.0] * (dim - 1), 2)]
    return out + [(n + 5, [float("inf")] * dim, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1), (n + 8, [0.0] * dim, None), (None, out[3][1], 2)]


def key_order(ids):
    return (ids is None, ids if ids is not None else 0)


def plain_rounds(x, books, parts, rounds):
    width = x.shape[1] // parts
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]

    def assign():
        d = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books, strict=True)]
        return [y.argmin(axis=1) for y in d], sum(y.min(axis=1) for y in d)

    for _ in range(rounds):
        codes, _ = assign()
        for p, b in enumerate(books):
            for e in range(len(b)):
                mine = cut[p][codes[p] == e]
                if len(mine):
                    b[e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    return assign()


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(90, 4, 16, 4), (40, 2, 256, 3), (60, 1, 5, 6), (30, 4, 8, 0)])
def test_codes_against_plain_rounds(spark, n, parts, entries, rounds):
    vectors = awkward(n, 8)
    kept = [v for v in vectors if usable(v[1]) and len(v[1]) == 8]
    x = np.floor(np.array([v[1] for v in kept]) * 1024).astype(np.int64)
    first = sorted(range(len(kept)), key=lambda k: (*key_order(kept[k][0]), x[k].tolist()))[:entries]
    books = [b.copy() for b in np.split(x[first], parts, axis=1)]
    codes, error = plain_rounds(x, books, parts, rounds)
    label_error = {v[2]: sum(int(e) for w, e in zip(kept, error, strict=True) if w[2] == v[2]) for v in kept}
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    want = sorted((str(v[0]), "".join(f"{c[k]:02x}" for c in codes), int(error[k]), label_error[v[2]], digest) for k, v in enumerate(kept))
    out = veccodes.compress(make(spark, vectors), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out) == want


@pytest.mark.parametrize(("n", "k", "rounds"), [(120, 12, 5), (20, 40, 3), (50, 1, 2)])
def test_clusters_against_plain_rounds(spark, n, k, rounds):
    vectors = awkward(n, 8)
    kept = [v for v in vectors if usable(v[1]) and len(v[1]) == 8]
    x = np.floor(np.array([v[1] for v in kept]) * 256).astype(np.int64)
    drawn = [(v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest()) for v in kept]
    first = sorted(range(len(kept)), key=lambda i: (drawn[i], x[i].tolist()))[:k]
    books = [x[first].copy()]
    (code,), distance = plain_rounds(x, books, 1, rounds)
    inertia = {c: int(distance[code == c].sum()) for c in set(code.tolist())}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in books[0].tolist()]
    want = sorted((str(v[0]), int(code[i]), int(distance[i]), inertia[code[i]], int(distance.sum()), digest[code[i]]) for i, v in enumerate(kept))
    out = centroids.cluster(make(spark, vectors), k=k, rounds=rounds, dimension=8).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out) == want


def test_bounds_spare_comparisons_and_lose_none(monkeypatch):
    """Either search scans fewer entries than all, and gives the codes of the full comparison."""
    draw = np.random.default_rng(1)
    x = np.rint(draw.normal(size=(20, 6))[draw.integers(0, 20, 2000)] * 400 + draw.normal(size=(2000, 6)) * 20).astype(np.int64)
    whole = lloyd.Book.scan
    for search in (veccodes.hamerly, centroids.exponion):
        entries, before, seen = x[:20].copy(), None, []
        monkeypatch.setattr(lloyd.Book, "scan", lambda self, rows, among=None, seen=seen: seen.append(len(rows) * (len(self.entries) if among is None else len(among))) or whole(self, rows, among))
        for turn in range(6):
            book = lloyd.Book(entries, before)
            if turn == 0:
                code, upper, lower = book.scan(x)
            else:
                search(book, x, code, upper, lower)
            d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (code == d.argmin(axis=1)).all()
            assert (upper >= np.sqrt(d.min(axis=1))).all()
            assert (lower <= np.sqrt(np.partition(d, 1, axis=1)[:, 1])).all()
            before, entries = entries, np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else entries[e] for e in range(20)])
        assert sum(seen) < 0.7 * 6 * 2000 * 20


def test_large_integers_stay_exact(spark):
    vectors = [(k, [30000.0 + k, -60000.0 + 0.001 * k, 65000.0, 1.0], 1) for k in range(9)] + [(9, [1e30, 0.0, 0.0, 0.0], 1)]
    out = {r.vec_id: r for r in veccodes.compress(make(spark, vectors), parts=2, entries=2, rounds=1).collect()}
    assert sorted(out) == list(range(9))
    x = np.floor(np.array([np.array(v[1], np.float32).astype(float) for v in vectors[:9]]) * 1024).astype(np.int64)
    books = [b.copy() for b in np.split(x[:2], 2, axis=1)]
    assert [out[k].error for k in range(9)] == plain_rounds(x, books, 2, 1)[1].tolist()


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [None], 1), (2, [], None)]):
        df = make(spark, rows)
        assert veccodes.compress(df).collect() == [] == centroids.cluster(df).collect()
        assert vptrees.nearest(df, "true").collect() == []
    assert veccodes.compress(make(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert centroids.cluster(make(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_nearest(vectors, asks, k):
    """(query, rank, candidate, score) by comparing all, of the rows of which none is left out."""
    kept = [v for v in vectors if v[0] is not None and v[1] and usable(v[1]) and any(v[1])]
    out = []
    for i, q in enumerate(kept):
        if asks(q[0]):
            a = np.array(q[1], np.float32).astype(float)
            met = []
            for j, c in enumerate(kept):
                if i != j and len(c[1]) == len(q[1]):
                    b = np.array(c[1], np.float32).astype(float)
                    met.append((-round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 12), c[0]))
            out += [(q[0], rank + 1, v, -s) for rank, (s, v) in enumerate(sorted(met)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_bytes", "leaf"), [(vptrees.SHARD_BYTES, vptrees.LEAF), (8 * 8 * 20, 4), (1, 2)])
def test_nearest_against_all_pairs(spark, shard_bytes, leaf):
    vectors = awkward(150, 8) + [(500 + k, [1.0, 0.5] + [0.0] * 6, 1) for k in range(60)]
    out = vptrees.nearest(make(spark, vectors), "vec_id % 10 = 0", shard_bytes=shard_bytes, leaf=leaf).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12) + 0.0) for r in out) == plain_nearest(vectors, lambda v: v % 10 == 0, 5)


def test_nearest_of_few_and_of_huge_components(spark):
    vectors = [(0, [1e30, 1e30], 1), (50, [3e-30, 0.0], 1), (51, [0.0, 2e38], 1)]
    out = vptrees.nearest(make(spark, vectors), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]


def test_a_factor_trades_recall_for_comparisons():
    """On clustered vectors a larger factor compares fewer and keeps nine tenths; factor one keeps all."""
    draw = np.random.default_rng(3)
    raw = draw.normal(size=(40, 16))[draw.integers(0, 40, 6000)] + 0.25 * draw.normal(size=(6000, 16))
    ids = np.arange(6000)
    shard, queries = vptrees.Shard(raw, ids, ids, leaf=64), ids[::50]
    unit = vptrees.unit_rows(raw)
    close = unit[queries] @ unit.T
    close[np.arange(len(queries)), queries] = -2
    true = np.argsort(-close, axis=1, kind="stable")[:, :5]
    cost, recall = [], []
    for factor in (1.0, 1.5, 3.0):
        found = vptrees.Found(len(queries), 5)
        cost.append(shard.search(raw[queries], queries, found, factor))
        recall.append(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.id.tolist(), true.tolist(), strict=True)]))
    assert recall[0] == 1 and recall[1] >= 0.9 and cost[2] < cost[1] < cost[0] < len(queries) * 6000

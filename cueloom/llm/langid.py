"""Language identification by the nearest of several centroids for each language.

A text's letters, in lower case, give hashed byte n-grams of 1 to 3 bytes; their counts, damped by
a square root and weighted by inverse document frequency, are a vector of length one. Training
clusters the vectors of each language into a few centroids (spherical k-means). A text gets the
language of the centroid with the largest cosine, which is its score. A text is rejected if it is much
further from that centroid than the rows that made it: below ``REJECT_SHARE`` of the cosine that all
but a hundredth of them reach.

The model is fitted on a bounded sample: of each language the ``SAMPLE`` labelled training rows
whose hashed key is smallest. Each language is clustered in a task of its own. The model is languages * CENTROIDS *
DIMENSIONS * 4 bytes (128 kB a language) for at most LANGUAGES languages, which bounds what the driver holds and broadcasts;
the sizes and cuts of languages that are broadcast while it is fitted are a few bytes each. Every row is then predicted from its whole text alone.

Cases: a label ``und`` is not learned from; a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text
if there was nothing to learn from; rows with a null label are predicted but not learned from;
languages that tie go to the first in alphabetical order; repeated rows each keep a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import cut, small_batches

UNDETERMINED = "und"
DIMENSIONS, LONGEST = 8192, 3
#: Rows of a language that the model is fitted on, at most, and its centroids.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 12
#: Languages at most: a model of 256 MB.
LANGUAGES = 2000
#: A cosine is too small below this share of the quantile ``REJECT_QUANTILE`` of a centroid's own rows,
#: or of the language's, if the centroid has fewer than ``OWN_ROWS``.
REJECT_SHARE, REJECT_QUANTILE, OWN_ROWS = 0.36, 0.01, 50
#: ASCII letters in lower case, other ASCII as a space, everything else as it is.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of a text with letters, one after the other."""
    clean = b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "
    code = b = np.frombuffer(clean, dtype=np.uint8).astype(np.uint32)
    out = []
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        mixed = (code + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(19))
    return np.concatenate(out)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # inverse document frequencies
    centroids: np.ndarray  # rows: the centroids of a language, language after language
    limits: np.ndarray  # the least cosine that is not rejected, of each centroid

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language of each row of counts, the cosine, and whether that is too small."""
        cosines = unit_rows(np.sqrt(counts) * self.weights) @ self.centroids.T
        nearest = cosines.argmax(axis=1)
        found = cosines[np.arange(len(nearest)), nearest]
        return nearest // CENTROIDS, np.clip(found, 0, 1).astype(np.float64), found < self.limits[nearest]


def cluster(x: np.ndarray, seed: int) -> np.ndarray:
    """Spherical k-means of unit rows, started from rows far from each other."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    for _ in range(CENTROIDS - 1):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    centre = x[picked]
    for _ in range(ROUNDS):
        of = (x @ centre.T).argmax(axis=1)
        # A centroid that has lost its rows stays where it is.
        centre = unit_rows(np.stack([x[of == k].sum(axis=0) if (of == k).any() else centre[k] for k in range(CENTROIDS)]))
    return centre


def limits_of(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The least cosine that is not rejected, of each centroid of the unit rows of a language."""
    cosines = x @ centre.T
    of, best = cosines.argmax(axis=1), cosines.max(axis=1)
    low = [np.quantile(best[of == k] if (of == k).sum() >= OWN_ROWS else best, REJECT_QUANTILE) for k in range(len(centre))]
    return REJECT_SHARE * np.array(low)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of ``docs``; more languages than ``LANGUAGES`` are refused."""
    rows = docs.where(F.col(label).isNotNull() & (F.col(label) != UNDETERMINED) & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    # Hashes are even, so three times the sample's share of a language has enough rows in it, and few go on.
    sizes = cut(rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    if sizes.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), 3 * sample / F.col("size"))
    able = rows.select("label", "h").join(F.broadcast(sizes), "label").where((F.col("size") <= 50) | (F.col("h") <= share))
    # Spark limits such a window before it shuffles: each task sends so many rows of a language at most.
    least = able.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("n") <= sample)
    cut_at = least.groupBy("label").agg(F.max("h").alias("cut"))

    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for name, h, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(item):
                    at, n = np.unique(ngrams(item), return_counts=True)
                    for column, value in zip(columns, (name, h, at.astype(np.int32), n.astype(np.int32)), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "h", "at", "n"])

    picked = rows.join(F.broadcast(cut_at), "label").where("h <= cut").select("label", "h", "text")
    found = picked.mapInArrow(features, "label string, h long, at array<int>, n array<int>")
    # Repeated keys share a hash, so the sample is counted once more; tasks again send so many rows of a language at most.
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "at", "n"))
    kept = cut(found.withColumn("place", place).where(F.col("place") <= sample))
    languages = sorted(r["label"] for r in kept.select("label").distinct().collect())
    in_docs = np.zeros(DIMENSIONS)
    for at, n in kept.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # one row a dimension
        in_docs[at] = n
    weights = np.log((1 + kept.count()) / (1 + in_docs)).astype(np.float32) + 1
    seeds = {name: seed for seed, name in enumerate(languages)}

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        x = np.zeros((group.num_rows, DIMENSIONS), dtype=np.float32)
        for k, (at, n) in enumerate(zip(group["at"], group["n"], strict=True)):
            x[k, at.values.to_numpy()] = n.values.to_numpy()
        name = group["label"][0].as_py()
        unit = unit_rows(np.sqrt(x) * weights)
        centre = cluster(unit, seeds[name])
        return pa.table({"label": [name], "centroids": [centre.astype("<f4").tobytes()], "limits": [limits_of(unit, centre).astype("<f8").tobytes()]})

    # Each language is clustered in a task of its own, of one bounded sample; the driver gets its centroids.
    fitted = {r["label"]: r for r in kept.groupBy("label").applyInArrow(fit, "label string, centroids binary, limits binary").collect()}
    centroids = [np.frombuffer(fitted[name]["centroids"], "<f4").reshape(-1, DIMENSIONS) for name in languages]
    limits = [np.frombuffer(fitted[name]["limits"], "<f8") for name in languages]
    return Model(languages, weights, np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *centroids]), np.concatenate([np.zeros(0), *limits]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    added = ("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at = [f.name for f in kept].index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in stream:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                counts = np.zeros((batch.num_rows, DIMENSIONS), dtype=np.float32)
                fit = np.zeros(batch.num_rows, dtype=bool)
                for k, item in enumerate(batch.column(at)):
                    value = item.as_py()
                    if value and own.languages and has_letter(value):
                        fit[k] = True
                        counts[k] = np.bincount(ngrams(value), minlength=DIMENSIONS)
                name = np.full(batch.num_rows, UNDETERMINED, dtype=object)
                score, rejected = np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
                if fit.any():
                    best, score[fit], rejected[fit] = own.score(counts[fit])
                    name[fit] = np.array(own.languages, dtype=object)[best]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(nearest, schema)


def held_out(key: Column, parts: int = 4, which: int = 2) -> Column:
    """True for the rows that training has to leave out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == which, F.lit(False))

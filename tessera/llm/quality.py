"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are its pairs of adjacent bytes: they show case, marks and
separators as well as language.  Pair counts are damped, weighed by inverse
document frequency over all documents and scaled to length one; a truncated
singular value decomposition of the labelled texts gives the latent space.
The labelled vectors are broadcast, every document's cosines with all of them
are computed in blocks, and the nearest vote with weights by similarity.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import extended, text_batches
from .words import byte_groups

FEATURES = 4096
#: Labelled texts that are broadcast, those with the smallest hash of their id: the bound of what is learnt from.
LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
#: Similarities are raised to this power as weights of votes.
SHARPNESS = 8
THRESHOLD = 0.7
_SLICE = 1 << 20

#: Byte pairs to features: a byte's class and the pair's hash.
_PAIRS = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def pair_counts(texts: list[bytes | None]) -> np.ndarray:
    """Counts of hashed byte pairs, a row for each text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        # In parts, which overlap by a byte, so that a long text needs no more memory.
        for a in range(0, max(0, len(text or b"") - 1), _SLICE):
            raw = np.frombuffer(text, np.uint8, min(_SLICE + 1, len(text) - a), a)
            pairs = _PAIRS[(raw[:-1].astype(np.int64) << 8) | raw[1:]]
            out[i] += np.bincount(pairs, minlength=FEATURES)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and the number of documents."""

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for part in byte_groups([len(t or b"") for t in texts], _SLICE):
                for a in range(part.start, part.stop, 256):
                    total += (pair_counts(texts[a : min(a + 256, part.stop)]) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, n))], names=["feature", "n"])

    sums = docs.select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for feature, n in sums:
        df[feature] = n
    return df[:-1], int(df[-1])


def labelled_counts(docs: DataFrame, labels: DataFrame, text: str, row_id: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of the bounded sample of labelled texts, in order of id."""
    own = labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull()).groupBy(row_id).agg(F.avg(label).alias("y"))
    sample = own.orderBy(F.xxhash64(row_id), row_id).limit(most)

    def count(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [zlib.compress(row.tobytes(), 1) for a in range(0, len(texts), 64) for row in pair_counts(texts[a : a + 64])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["id", "y", "counts"])

    # The sample is bounded by ``most`` rows of two numbers, the counts by ``most`` rows of mostly zeros.
    found = docs.select(F.col(row_id), F.col(text)).join(F.broadcast(sample), row_id).select(F.col(row_id).cast("string").alias("id"), text, "y").mapInArrow(count, "id string, y double, counts binary")
    rows = sorted({(r["id"], bytes(r["counts"]), r["y"]) for r in found.collect()})
    counts = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(zlib.decompress(r[1]), np.float32)
    return counts, np.array([r[2] for r in rows], np.float32)


def latent_space(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, as columns, by subspace iteration."""
    rng = np.random.default_rng(0)
    k = min(dimensions, *x.shape) if min(x.shape) else 0
    if not k:
        return np.zeros((x.shape[1], 1), np.float32)
    q = np.linalg.qr(rng.standard_normal((x.shape[1], k)))[0].astype(np.float32)
    for _ in range(12):
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
    return q


class Model:
    """Labelled latent vectors, and what brings a text among them."""

    def __init__(self, counts: np.ndarray, y: np.ndarray, df: np.ndarray, n: int, dimensions: int = DIMENSIONS):
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
        x = weigh(counts, self.idf)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES, np.float32)
        x -= self.mean
        self.axes = latent_space(x, dimensions)
        self.y = y
        self.prior = float(y.mean()) if len(y) else 0.5
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        counts = pair_counts(texts)
        v = self._unit((weigh(counts, self.idf) - self.mean) @ self.axes)
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.y))
        if not k:
            return out
        cosines = v @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** SHARPNESS
        total = weights.sum(axis=1)
        known = (total > 1e-9) & (counts.sum(axis=1) > 0)
        out[known] = ((weights * self.y[near]).sum(axis=1)[known]) / total[known]
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality", most: int = LABELLED, dimensions: int = DIMENSIONS) -> Model:
    """Document frequencies over all of ``docs``; vectors of at most ``most`` labelled ones."""
    text_batches(docs.sparkSession)
    df, n = document_frequencies(docs, text)
    counts, y = labelled_counts(docs, labels, text, row_id, label, most)
    return Model(counts, y, df, n, dimensions)


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1) and predicted (score >= 0.7).

    Only the text counts.  Null, empty and one-byte texts, and texts like no
    labelled one, get the labelled share of 1 (0.5 if nothing is labelled).
    Repeated rows and ties of similarity get equal scores.  Other columns are
    carried along, those named as the new ones are replaced; an empty table
    gives an empty result.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs.schema, "score double, predicted int")
    at = docs.columns.index(text)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            scores = np.concatenate([model.score(texts[a : a + 256]) for a in range(0, len(texts), 256)]) if texts else np.empty(0)
            scores = np.round(scores, 6)
            own = [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, schema)


def held_out(row_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % 4 == 2, F.lit(False))

"""Near-duplicate documents by improved consistent weighted sampling.

A document is a weighted set of its five-word shingles, weights being TF-IDF.
Consistent weighted sampling draws, for each of K hash functions, one (shingle,
level) such that two documents agree with the probability of their weighted
Jaccard similarity.  Samples are banded; documents that agree in a band are
candidates, whose weighted Jaccard similarity is then computed exactly.

Document frequencies count all documents, copies included.  A shingle that is
in less than the share FLOOR of all (document, shingle) pairs counts as of that
share.  So exact counts are needed of the frequent shingles only, of which
there are at most 1 / FLOOR, whatever the corpus and however long its documents.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Joined, link_groups
from .scratch import Scratch, text_batches
from .words import Words, byte_groups, mix, shingles

SHINGLE = 5
SIMILARITY = 0.8
#: 16 bands of 4 samples: a pair of similarity 0.8 shares none with probability 0.0002.
BANDS, ROWS = 16, 4
#: Shingles of a smaller share of all (document, shingle) pairs count as of this.
FLOOR = 2**-16
#: Pairs that a task counts together at least, if it has as many, before the frequent shingles are passed on.
_BLOCK_PAIRS = 1 << 22
#: Small partitions of which one task counts the pairs, as long as there is a task for each core.
_PARTS_TOGETHER = 32
_SLICE = 2 << 20
_BITS = 12


def distinct_shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles (text number, shingle, times), sorted by both."""
    found, owner = shingles(Words(texts), SHINGLE)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], found[at], np.diff(np.append(at, len(found)))


def _texts(batches, column: int):
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        for part in byte_groups([len(t or b"") for t in texts], _SLICE):
            yield texts[part]


def frequent_shingles(docs: DataFrame, text: str, scratch: Scratch, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Shingles in over ``floor`` of all (document, shingle) pairs, their document frequencies, the number of documents, and the frequency that is the floor.

    A first pass reports, for each block of pairs, the shingles that have at
    least a quarter of the floor's share of the block.  What is not reported
    adds up to less than a quarter, so every frequent shingle has reports of
    three quarters: 4 / (3 * floor) shingles at most, which are counted exactly
    in a second pass.
    """
    own = docs.select(F.col(text).alias("t"))
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, own.rdd.getNumPartitions() // _PARTS_TOGETHER)

    def report(batches):
        held, docs_held, pairs = [], 0, 0

        def flush(n_parts):
            parts = held[:n_parts]
            del held[:n_parts]
            found, n = np.unique(np.concatenate([p for _, p in parts]), return_counts=True)
            often = n >= max(1, math.ceil(floor / 4 * n.sum()))
            names = [0, 1, *found[often].view(np.int64).tolist()]
            kinds = [1, 2, *([0] * int(often.sum()))]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.int64()), pa.array([sum(d for d, _ in parts), int(n.sum()), *n[often].tolist()], pa.int64())], names=["kind", "shingle", "n"])

        for texts in _texts(batches, 0):
            _, found, _ = distinct_shingles(texts)
            held.append((len(texts), found))
            pairs += len(found)
            # What is left over is at least a block, too.
            if pairs >= 2 * _BLOCK_PAIRS:
                sizes = np.cumsum([len(p) for _, p in held])
                n_parts = int(np.searchsorted(sizes, _BLOCK_PAIRS)) + 1
                pairs -= int(sizes[n_parts - 1])
                yield flush(n_parts)
        if held:
            yield flush(len(held))

    reports = scratch.write(own.coalesce(n_tasks).mapInArrow(report, "kind int, shingle long, n long").groupBy("kind", "shingle").agg(F.sum("n").alias("n")), "reports")
    totals = {r["kind"]: r["n"] for r in reports.where("kind > 0").collect()}
    n_docs, least = totals.get(1, 0), floor * totals.get(2, 0)
    none = np.empty(0, np.uint64), np.empty(0, np.int64), n_docs, least
    likely = reports.where((F.col("kind") == 0) & (F.col("n") >= 0.75 * least)).select("shingle")
    likely = np.sort(likely.toArrow().column(0).to_numpy().view(np.uint64))
    if not len(likely):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(likely)

    def count(batches):
        keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for texts in _texts(batches, 0):
            _, found, _ = distinct_shingles(texts)
            at = np.searchsorted(keys, found)
            at[at == len(keys)] = 0
            total += np.bincount(at[keys[at] == found], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    exact = own.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    found, counts = exact.column(0).to_numpy().view(np.uint64), exact.column(1).to_numpy()
    order = np.argsort(found)
    return found[order], counts[order], n_docs, least


class Weights:
    """TF-IDF weights of shingles; those not in ``found`` have the frequency ``least``, and 1 if that is less."""

    def __init__(self, found: np.ndarray, counts: np.ndarray, n_docs: int, least: float):
        self.found = found
        self.idf = np.log1p(n_docs / np.maximum(counts, 1)).astype(np.float32)
        self.rare = np.float32(math.log1p(n_docs / max(least, 1)))

    def __call__(self, names: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.full(len(names), self.rare, np.float32)
        if len(self.found):
            at = np.searchsorted(self.found, names)
            at[at == len(self.found)] = 0
            hit = self.found[at] == names
            out[hit] = self.idf[at[hit]]
        return out * times.astype(np.float32)


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the midpoints of 2**_BITS equal shares, and its logarithm."""
    p = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(owner: np.ndarray, names: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """k consistent weighted samples of each of n texts as hashes of (shingle, level); texts without shingles get zeros."""
    out = np.zeros((n, k), np.uint64)
    if not len(names):
        return out
    gamma, log_gamma = _quantiles()
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    lengths = np.diff(np.append(starts, len(owner)))
    logs = np.log(weights)
    mask = np.uint64((1 << _BITS) - 1)
    for i in range(k):
        h = (names ^ np.uint64((0xA0761D6478BD642F * (i + 1)) % 2**64)) * np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        r = gamma[(h >> np.uint64(52)).view(np.int64)]
        c = log_gamma[((h >> np.uint64(40)) & mask).view(np.int64)]
        beta = ((h >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.float32)
        beta *= np.float32(1 / 65536)
        level = np.floor(logs / r + beta)
        # ln a = ln c - r (level - beta) - r; the least wins.
        c -= r * (level - beta + np.float32(1))
        least = np.minimum.reduceat(c, starts)
        at = np.flatnonzero(c == np.repeat(least, lengths))
        text, first = np.unique(owner[at], return_index=True)
        at = at[first]
        out[text, i] = names[at] ^ mix(level[at].astype(np.int64).view(np.uint64) + np.uint64(1))
    return out


def bands(of: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band, unlike between bands."""
    n, k = of.shape
    out = np.zeros((n, k // rows), np.uint64)
    for j in range(k // rows):
        h = np.full(n, j + 1, np.uint64)
        for i in range(j * rows, (j + 1) * rows):
            h = mix(h * np.uint64(0xE7037ED1A0B428DB) + of[:, i])
        out[:, j] = h
    return out.view(np.int64)


def weighted_jaccard(weights: Weights, x: bytes, y: bytes) -> float:
    return float(similarities(weights, [x], [y])[0])


def similarities(weights: Weights, xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of texts; texts without words are like none."""
    n = len(xs)
    owner, names, times = distinct_shingles([*xs, *ys])
    w = weights(names, times).astype(np.float64)
    total = np.bincount(owner, w, 2 * n)
    pair = owner % n
    order = np.lexsort((names, pair))
    pair, names, w = pair[order], names[order], w[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (names[1:] == names[:-1]))
    common = np.bincount(pair[same], np.minimum(w[same], w[same + 1]), n)
    whole = total[:n] + total[n:] - common
    return np.where(whole > 0, common / np.maximum(whole, 1e-300), 0.0)


class _Table:
    """Shingles of the bodies of some groups, each group's in order of shingle to look up by."""

    def __init__(self, bodies: list[bytes], weights: Weights):
        n = len(bodies)
        self.owner, self.names, times = distinct_shingles(bodies)
        self.w = weights(self.names, times).astype(np.float64)
        self.total = np.bincount(self.owner, self.w, n)
        self.bounds = np.searchsorted(self.owner, np.arange(n + 1))

    def index(self, a: int, b: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, body less a, weight) of bodies a to b (those of ``of``), in order of shingle."""
        at = np.arange(self.bounds[a], self.bounds[b])
        if of is not None:
            at = at[of[self.owner[at] - a]]
        at = at[np.argsort(self.names[at], kind="stable")]
        return self.names[at], self.owner[at] - a, self.w[at]

    def alike(self, row: int, a: int, b: int, index: tuple, similarity: float) -> np.ndarray:
        """Which of bodies a to b, as numbers from a, have the similarity to ``row``."""
        own = slice(self.bounds[row], self.bounds[row + 1])
        names, owner, w = index
        low, high = np.searchsorted(names, self.names[own], "left"), np.searchsorted(names, self.names[own], "right")
        times = high - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        common = np.bincount(owner[at], np.minimum(np.repeat(self.w[own], times), w[at]), b - a)
        return np.flatnonzero((common > 0) & (common >= similarity * (self.total[row] + self.total[a:b] - common)))


def _classes(bodies: list[bytes], bounds: np.ndarray, weights: Weights, similarity: float) -> np.ndarray:
    table, out = _Table(bodies, weights), np.arange(len(bodies))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            joined, index = Joined(b - a), table.index(a, b)
            while (row := joined.next()) is not None:
                joined.add(row, table.alike(a + row, a, b, index, similarity))
            out[a:b] = a + joined.members()
    return out


def _cross(bodies: list[bytes], bounds: np.ndarray, outside: np.ndarray, comps: np.ndarray, pairs, weights: Weights, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    # One look-up of a row's shingles compares it with the whole block, which costs less than to leave out pairs.
    table, found = _Table(bodies, weights), set()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        index, own = table.index(a, b, ~outside[a:b]), comps[a:b]
        for row in np.flatnonzero(outside[a:b]):
            like = np.unique(own[table.alike(a + row, a, b, index, similarity)])
            found.update((min(own[row], c), max(own[row], c)) for c in like[like != own[row]].tolist())
    links = np.array(sorted(found), np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def _node():
    return F.unhex(F.md5("_text"))


def near_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id", similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(row_id, node, class_id, group_size, kept), a row for each row of ``docs``.

    Documents of one class are linked by pairs of equal text or of a weighted
    Jaccard similarity of at least ``similarity``.  class_id is the smallest id
    of the class, nulls last; that row is kept, and of repeated rows with the
    same id and text only one.  A null text counts as empty; texts without
    words have no shingles and are alike only if equal; texts of fewer than
    five words are one shingle; long texts are taken whole.  ``node`` tells
    equal texts.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = scratch or Scratch(spark, "near")
    own = docs.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("node", _node())
    weights = Weights(*frequent_shingles(own, "_text", scratch))
    shared = spark.sparkContext.broadcast(weights)

    def sign(batches):
        weights = shared.value
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            out = []
            for part in byte_groups([len(t) for t in texts], _SLICE):
                n = part.stop - part.start
                owner, names, times = distinct_shingles(texts[part])
                keys = bands(samples(owner, names, weights(names, times), n, BANDS * ROWS))
                some = np.bincount(owner, minlength=n) > 0
                out += [row if has else [] for row, has in zip(keys.tolist(), some)]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(out, pa.list_(pa.int64()))], names=["id", "node", "size", "bands"])

    signed = scratch.write(own.select("id", "node", "_text").mapInArrow(sign, "id long, node binary, size long, bands array<long>"), "signed")
    # Equal texts are one node, whose least id stands for them.
    nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = scratch.write(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))

    def fetch(homes: DataFrame) -> DataFrame:
        """Any row of a node has its text; of an often repeated one, only that with the least id is taken."""
        key = F.coalesce("id", F.lit(0)).alias("_key")
        picked = homes.join(nodes.select("node", key), "node").hint("shuffle_hash")
        return own.select("node", key, F.col("_text").alias("body")).join(picked, ["node", "_key"]).drop("_key")

    classes = lambda bodies, bounds: _classes(bodies, bounds, shared.value, similarity)
    cross = lambda bodies, bounds, outside, comps, pairs: _cross(bodies, bounds, outside, comps, pairs, shared.value, similarity)
    comp = link_groups(members, fetch, classes, cross, scratch)
    of_node = nodes.select("node", "id", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_class = of_node.groupBy("comp").agg(F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("_keep"), F.min("id").alias("class_id"), F.sum("n").alias("group_size"))
    by_node = of_node.join(of_class, "comp").select("node", F.col("id").alias("_least"), "class_id", "group_size", (F.col("node") == F.col("_keep")).alias("_first"))
    # Repeated rows are counted, so that a text that many documents share is not one task's.
    rows = signed.groupBy("id", "node").agg(F.count(F.lit(1)).cast("int").alias("_n")).join(by_node, "node")
    kept = F.col("_first") & F.col("id").eqNullSafe(F.col("_least"))
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(F.col("id").alias(row_id), "node", "class_id", "group_size", (kept & (F.col("_turn") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The kept row of each class of ``near_groups``, all columns as they were; what that says of nulls, ties and repeated rows holds."""
    keys = lambda id_, node: (node.alias("__t_node"), id_.isNull().alias("__t_null"), F.coalesce(id_, F.lit(0)).alias("__t_id"))
    keep = near_groups(docs, text, row_id, similarity).where("kept").select(*keys(F.col(row_id), F.col("node")))
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *keys(F.col(row_id).cast("long"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))))
    names = ["__t_node", "__t_null", "__t_id"]
    return own.join(keep, names).dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Benchmark decontamination by winnowing.

Of each text's k-word hashes, winnowing keeps the smallest in every window of
w; two texts that share w + k - 1 consecutive words keep the same hash at the
same place of that span.  So with w = span - k + 1 every shared span of
``span`` words gives a common fingerprint.  Fingerprints of documents are
joined with those of the benchmark inside the scan, and each hit is extended
to both sides, word by word, which makes the result exact.

An item of fewer words than a span is one window of its own length: its
fingerprint is the hash of all its words (k = length, w = 1).

The benchmark is taken in blocks of a bounded number of words, each broadcast
once: one block for usual benchmarks, and a pass over the documents for each
block of a larger one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, extended, once, text_batches
from .words import Words, byte_groups, grams

SPAN = 13
GRAM = 6
#: UTF-8 bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 32 << 20
_SLICE = 4 << 20


def fingerprints(grams_of: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Places that winnowing keeps: the rightmost minimum of each window of w places that are valid for it."""
    n = len(grams_of) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams_of, w)[:, ::-1]
    starts = np.flatnonzero(valid[:n])
    kept = []
    for block in range(0, len(starts), 1 << 18):
        at = starts[block : block + (1 << 18)]
        kept.append(at + w - 1 - windows[at].argmin(axis=1))
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def _winnow(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the fingerprints of all texts."""
    hashes = grams(words.hashes, k)
    valid = np.zeros(max(0, len(words.hashes) - span + 1), bool)
    counts = np.diff(words.bounds)
    for a, n in zip(words.bounds[:-1], counts):
        if n >= span:
            valid[a : a + n - span + 1] = True
    at = fingerprints(hashes, valid, span - k + 1)
    return hashes[at], at


class Block:
    """Fingerprints of some benchmark texts, and their words to extend hits in."""

    def __init__(self, texts: list[bytes], span: int, k: int):
        self.span, self.k = span, k
        self.words: list[list[bytes]] = []
        self.long: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, text in enumerate(texts):
            words = Words([text])
            n = len(words.hashes)
            self.words.append([words.word(j) for j in range(n)])
            if 0 < n < span:
                self.short[n][int(grams(words.hashes, n)[0])].append(i)
            elif n:
                seen = set()
                for h, at in zip(*_winnow(words, span, k)):
                    # The words that a hit could extend to; repeats of them add nothing.
                    around = (int(h), tuple(self.words[i][max(0, at - span + k) : at + span]), min(int(at), span - k))
                    if around not in seen:
                        seen.add(around)
                        self.long[int(h)].append((i, int(at)))
        self.keys = np.sort(np.fromiter(self.long, np.uint64, len(self.long)))
        self.short_keys = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    def hits(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text: ranges of hit words, and the benchmark texts that occur."""
        out: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
        text_of = lambda at: int(np.searchsorted(words.bounds, at, side="right")) - 1
        hashes, places = _winnow(words, self.span, self.k)
        for h, at in _present(hashes, places, self.keys):
            doc = text_of(at)
            low, high = int(words.bounds[doc]), int(words.bounds[doc + 1])
            reach = self.span - self.k
            from_ = max(low, at - reach)
            own = [words.word(j) for j in range(from_, min(high, at + self.span))]
            for i, place in self.long[h]:
                item = self.words[i]
                a, b = at - from_, place
                if own[a : a + self.k] != item[b : b + self.k]:
                    continue
                left = 0
                while left < min(a, b, reach) and own[a - left - 1] == item[b - left - 1]:
                    left += 1
                right = self.k
                while a + right < len(own) and b + right < len(item) and own[a + right] == item[b + right]:
                    right += 1
                if left + right >= self.span:
                    out[doc][0].append((at - left - low, at + right - low))
                    out[doc][1].add(i)
        counts = np.diff(words.bounds)
        for n, keys in self.short_keys.items():
            hashes = grams(words.hashes, n)
            if not len(hashes):
                continue
            for h, at in _present(hashes, np.arange(len(hashes)), keys):
                doc = text_of(at)
                if at - words.bounds[doc] + n > counts[doc]:
                    continue
                own = [words.word(j) for j in range(at, at + n)]
                for i in self.short[n][h]:
                    if own == self.words[i]:
                        low = int(words.bounds[doc])
                        out[doc][0].append((at - low, at - low + n))
                        out[doc][1].add(i)
        return out


def _present(hashes: np.ndarray, places: np.ndarray, keys: np.ndarray):
    """(hash, place) of the hashes that are among the sorted keys."""
    if not len(keys) or not len(hashes):
        return
    found = np.searchsorted(keys, hashes)
    found[found == len(keys)] = 0
    at = np.flatnonzero(keys[found] == hashes)
    yield from zip(hashes[at].tolist(), places[at].tolist())


def union_length(ranges: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _classes(spark, benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct benchmark texts with words, each with all its ids as strings."""
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).where(F.col("body").isNotNull())
    return bench.groupBy("body").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, items (sorted ids as strings) and hits (word ranges).

    A word is hit if it lies in an occurrence of a window: ``span`` consecutive
    words of an item, or the whole item if it has fewer.  Null and empty texts
    have no words; items without words have no windows; items with a null id
    count as the id ''.  Long texts are read whole.  Other columns are carried
    along, those named as the new ones are replaced; an empty table or an empty
    benchmark gives no hits.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.drop("n_words", "n_hit", "items", "hits")
    shared, block, size = [], [], 0
    classes = _classes(spark, benchmark, item_id, "text")
    total = classes.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    for row in classes.collect() if total <= block_bytes else classes.toLocalIterator():
        block.append((row["body"].encode(), row["items"]))
        size += len(block[-1][0])
        if size > block_bytes:
            shared.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
    if block or not shared:
        shared.append(spark.sparkContext.broadcast(block))
    if len(shared) == 1:
        return _scan(docs, shared[0], text, span, gram)
    # A larger benchmark: a pass for each block, then each row's hits together.
    scratch = Scratch(spark, "leaks")
    docs = scratch.write(docs.withColumn("__t_row", F.expr("uuid()")), "rows")
    passes = [scratch.write(_scan(docs.select("__t_row", text), b, text, span, gram).drop(text), "pass") for b in shared]
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    merged = every.groupBy("__t_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")))
    return docs.join(merged.withColumn("n_hit", covered["n"]), "__t_row").drop("__t_row")


def _scan(docs: DataFrame, shared, text: str, span: int, gram: int) -> DataFrame:
    schema = extended(docs.schema, "n_words long, n_hit long, items array<string>, hits array<struct<a:long,b:long>>")
    at = docs.columns.index(text)

    def scan(batches):
        block = once(shared.value, ("block", span, gram), lambda v: Block([t for t, _ in v], span, gram))
        ids = [i for _, i in shared.value]
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            n_words, n_hit, items, hits = [], [], [], []
            for part in byte_groups([len(t or b"") for t in texts], _SLICE):
                words = Words(texts[part])
                found = block.hits(words)
                n_words += np.diff(words.bounds).tolist()
                for i in range(part.stop - part.start):
                    ranges, which = found.get(i, ([], set()))
                    ranges = sorted(set(ranges))
                    n_hit.append(union_length(ranges))
                    items.append(sorted({x for k in which for x in ids[k]}))
                    hits.append([{"a": a, "b": b} for a, b in ranges])
            own = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "n_words", "n_hit", "items", "hits"])

    return docs.mapInArrow(scan, schema)


def contaminated() -> Column:
    """A document is contaminated if a twentieth of its words, and one at least, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))

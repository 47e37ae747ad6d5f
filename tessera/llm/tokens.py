"""Token output in training order.

Texts become token ids, cut into sequences of a fixed number of ids.  With N
sequences in all, sequence i goes to slot P(i), where P is a keyed permutation
of 0..N-1: a Feistel network over the next even number of bits, walked along
its cycle until it lands below N.  Shard k holds the slots from k * stride on,
in order and at one fixed width, so that training reads shards front to back
and any slot is found by arithmetic: after a stop, reading resumes at the next
slot, and no index or shuffle buffer is kept.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, text_batches

SEQUENCE = 512
STRIDE = 1 << 16
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words whose ids a Python worker remembers.
_KNOWN_WORDS = 1_000_000
_ROUNDS = 4

# Fixed value: the split pattern of the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts without the characters of _odd(), in terms of the standard library.
_PLAIN = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Stands for a line end inside a chunk.
_LINE = "\ue000"
_SPACES = re.compile(r"\s\s")


@cache
def _odd() -> frozenset[str]:
    """Characters that the two patterns class unlike: numbers that are no decimal digits, and separators U+001C to U+001F."""
    numbers = (chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
    return frozenset([*map(chr, range(0x1C, 0x20)), *numbers])


class Tokenizer:
    """Byte-pair ids of texts as little-endian 16-bit numbers; ``end`` is the first id the vocabulary leaves free."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        if self.end >= 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        piece, pieces = self._whole._core_bpe.encode_single_piece, _PLAIN.findall

        class Known(dict):
            """Ids of what stands between two spaces, with the space or line end before it."""

            def __missing__(self, chunk):
                if len(self) >= _KNOWN_WORDS:
                    self.clear()
                text = "\n" + chunk[1:] if chunk[:1] == _LINE else " " + chunk
                ids = array("H")
                for part in pieces(text):
                    ids.extend(piece(part.encode()))
                out = self[chunk] = ids.tobytes()
                return out

        self._known, self._odd = Known(), _odd()

    def encode(self, text: str) -> bytes:
        """The ids that the vocabulary's own pattern gives.

        Where no two whitespace characters meet, every space or line end starts
        a piece, so texts can be cut there and the ids of known words joined.
        """
        if sys.byteorder != "little" or not self._odd.isdisjoint(text) or _LINE in text or _SPACES.search(text):
            return np.array(self._whole.encode_ordinary(text), "<u2").tobytes()
        first, *chunks = text.replace("\n", " " + _LINE).split(" ")
        known = self._known
        head = np.array(self._whole.encode_ordinary(first), "<u2").tobytes()
        return head + b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        return self._whole.decode([i for i in np.frombuffer(ids, "<u2").tolist() if i != self.end])


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker, which keeps the words it knows from task to task."""
    return Tokenizer(path)


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at the given places."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.Generator(np.random.Philox(key=[key, 1])).integers(0, 2**63, _ROUNDS).astype(np.uint64)

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return (left << half) | right

    x = once(index.astype(np.uint64))
    while (outside := x >= np.uint64(n)).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def sequences(docs: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, seq_no, n_tokens, ids (without padding), and the sequence's place: partition and number in it.

    A null or empty text is one sequence of the end mark; a null id stays null;
    repeated rows give sequences each; an empty table gives none.
    """
    text_batches(docs.sparkSession)
    names = ["doc_id", "seq_no", "n_tokens", "ids", "_part", "_at"]
    width = 2 * length

    def cut(batches):
        own, done, part = tokenizer(vocabulary), 0, TaskContext.get().partitionId()
        end = np.array([own.end], "<u2").tobytes()
        for batch in batches:
            rows, size = [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(t or "") + end
                for no, a in enumerate(range(0, len(ids), width)):
                    rows.append((i, no, ids[a : a + width]))
                size += len(ids)
                if size > 4 << 20:
                    yield make(rows, part, done)
                    done, rows, size = done + len(rows), [], 0
            if rows:
                yield make(rows, part, done)
                done += len(rows)

    def make(rows, part, done):
        ids, nos, blocks = zip(*rows)
        n = len(rows)
        arrays = [pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array([len(b) // 2 for b in blocks], pa.int32()), pa.array(blocks, pa.binary()), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    own = docs.select(F.col(row_id).cast("long"), F.col(text))
    return own.mapInArrow(cut, "doc_id long, seq_no int, n_tokens int, ids binary, _part int, _at long")


def write_training_order(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", length: int = SEQUENCE, stride: int = STRIDE, key: int = 0, vocabulary: str = VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """Write shards below ``path``; returns them as ``read_slots`` does.

    Every text gives its ids and one end mark, cut into sequences; the last is
    padded with end marks to the common width.  So a null or empty text gives
    one sequence of one end mark, and a very long text as many as it needs.
    Repeated rows give repeated sequences, each with a slot of its own; a null
    id stays null; other columns are left out.  An empty table writes no shard
    and gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    staged = scratch.write(sequences(docs, text, row_id, length, vocabulary), "sequences")
    # One count for each partition, no more than the driver has had tasks to schedule.
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    base, n = {}, 0
    for r in counts:
        base[r["_part"]], n = n, n + r["n"]
    bases = np.zeros(max(base, default=-1) + 1, np.int64)
    for part, at in base.items():
        bases[part] = at
    shared = spark.sparkContext.broadcast(bases)

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(feistel(shared.value[part.to_numpy()] + at.to_numpy(), n, key))

    shards = max(1, -(-n // stride))
    slots = staged.select("doc_id", "seq_no", "n_tokens", "ids", slot_of("_part", "_at").alias("slot")).withColumn("shard", F.expr(f"cast(slot div {stride} as int)"))
    (
        # A slot tells its shard, so ranges need no sampling; a shard is one task's and one file.
        slots.repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        # Each record is 2 * length bytes, and slot s is row s mod stride of its shard.
        .withColumn("ids", F.rpad("ids", 2 * length, F.lit(_end_bytes(vocabulary))))
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )
    scratch.drop(staged)
    return read_slots(spark, path)


def _end_bytes(vocabulary: str) -> bytearray:
    with open(vocabulary, "rb") as f:
        end = max(int(line.split()[1]) for line in f) + 1
    return bytearray(np.array([end], "<u2").tobytes())


SHARD_SCHEMA = "doc_id long, seq_no int, n_tokens int, ids binary, slot long, shard int"


def read_slots(spark: SparkSession, path: str, start: int = 0, end: int | None = None, stride: int = STRIDE) -> DataFrame:
    """Sequences of slots start to end; only their shards are opened, and only the row groups that hold the slots.

    Slots beyond the last give no rows; a folder without shards an empty result.
    """
    out = spark.read.schema(SHARD_SCHEMA).parquet(path)
    if start:
        out = out.where((F.col("shard") >= start // stride) & (F.col("slot") >= start))
    if end is not None:
        out = out.where((F.col("shard") <= (end - 1) // stride) & (F.col("slot") < end))
    return out

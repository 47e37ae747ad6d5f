"""Exact deduplication by Grace hashing.

Each input partition is first collapsed on its own, so that a text that fills
a third of the corpus crosses the exchange once a partition.  After the
exchange by hash, each partition is collapsed again.  Either time, records go
to an open-addressing table that compares complete contents; when its contents
pass the budget, the table and all later records go to spill files by the next
bits of the hash, and each file is treated alike, until it fits.

Spill files are a task's own, like Spark's shuffle spill: on the executor's
scratch disk, read by no one else and gone when the task ends.
"""

from __future__ import annotations

import pickle
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import text_batches

#: Bytes of distinct content in one table.
TABLE_BYTES = 64 << 20
_FAN_BITS = 4

_SPACE = r"[\x20\x09-\x0D]+"


class OpenTable:
    """Linear probing from hash to (content, smallest id, count); equal means equal content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, least, count: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (i := int(self.slots[at])) >= 0:
            entry = self.entries[i]
            if entry[0] == h and entry[1] == content:
                if entry[2] is None or (least is not None and least < entry[2]):
                    entry[2] = least
                entry[3] += count
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, least, count])
        self.bytes += len(content) + 100
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for i, entry in enumerate(self.entries):
            at = entry[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grace(records, budget: int = TABLE_BYTES, level: int = 0):
    """Distinct contents of (hash, content, least id, count) records, with least id and summed count."""
    table, spill = OpenTable(), None
    try:
        for record in records:
            table.add(*record)
            # 64 bits of hash give 16 levels; contents alike in all of them share a table.
            if table.bytes > budget and len(table.entries) > 1 and (level + 1) * _FAN_BITS <= 64:
                spill = spill or _Spill(level)
                spill.take(table.entries)
                table = OpenTable()
        if not spill:
            yield from table.entries
            return
        spill.take(table.entries)
        table = None
        for part in spill.parts():
            yield from grace(part, budget, level + 1)
    finally:
        if spill:
            spill.close()


class _Spill:
    def __init__(self, level: int):
        self.folder = tempfile.mkdtemp(prefix="grace-")
        self.shift = 64 - (level + 1) * _FAN_BITS
        self.files = [open(f"{self.folder}/{i}", "w+b") for i in range(1 << _FAN_BITS)]

    def take(self, entries) -> None:
        for entry in entries:
            pickle.dump(entry, self.files[(entry[0] >> self.shift) & ((1 << _FAN_BITS) - 1)], protocol=5)

    def parts(self):
        for f in self.files:
            f.flush()
            f.seek(0)
            yield self._read(f)
            f.truncate(0)

    @staticmethod
    def _read(f):
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return

    def close(self) -> None:
        for f in self.files:
            f.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def normalised(text: Column) -> Column:
    """Whitespace runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def distinct_texts(df: DataFrame, content: str, row_id: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct ``content``: content, least ``row_id`` (nulls last) and the number of rows."""
    text_batches(df.sparkSession)
    names = ["h", "content", "keep_id", "group_size"]
    schema = "h long, content string, keep_id long, group_size long"

    def batches(entries):
        block, size = [], 0
        for entry in entries:
            block.append(entry)
            size += len(entry[1])
            if size > 4 << 20 or len(block) >= 4096:
                yield _record_batch(block)
                block, size = [], 0
        if block:
            yield _record_batch(block)

    def _record_batch(block):
        h, content, least, count = zip(*block)
        arrays = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(content, pa.binary()).cast(pa.string()), pa.array(least, pa.int64()), pa.array(count, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def first(source):
        def records():
            for batch in source:
                contents = batch.column(0).cast(pa.binary()).to_pylist()
                for c, i in zip(contents, batch.column(1).to_pylist()):
                    yield xxhash.xxh3_64_intdigest(c), c, i, 1

        yield from batches(grace(records(), table_bytes))

    def second(source):
        def records():
            for batch in source:
                contents = batch.column(1).cast(pa.binary()).to_pylist()
                hashes = batch.column(0).to_numpy().view(np.uint64).tolist()
                yield from zip(hashes, contents, batch.column(2).to_pylist(), batch.column(3).to_pylist())

        yield from batches(grace(records(), table_bytes))

    own = df.select(F.col(content).alias("content"), F.col(row_id).cast("long").alias("row_id"))
    return own.mapInArrow(first, schema).repartition("h").mapInArrow(second, schema).drop("h")


def exact_groups(df: DataFrame, text: str = "text", row_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row of ``df`` with text_sha256, keep_id, group_size and kept.

    Texts are equal when identical after replacing whitespace runs by one
    space; null counts as empty, an empty text is a text like others.  The row
    with the smallest id of its group stays; a null id is larger than any.
    Among repeated rows with that same id, all count as kept, since nothing
    tells them apart.  Other columns are carried along; those named as the new
    ones are replaced.  An empty table gives an empty result.
    """
    new = ["text_sha256", "keep_id", "group_size", "kept"]
    df = df.drop(*new)
    norm = normalised(F.col(text))
    groups = distinct_texts(df.select(norm.alias("content"), F.col(row_id)), "content", row_id, table_bytes)
    groups = groups.select(F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    return (
        df.withColumn("text_sha256", F.sha2(norm, 256))
        .join(groups, "text_sha256", "left")
        .withColumn("kept", F.col(row_id).cast("long").eqNullSafe(F.col("keep_id")))
    )

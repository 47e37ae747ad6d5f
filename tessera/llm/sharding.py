"""Sharding by a hypergeometric communication matrix.

Entry (p, c) of the matrix is the number of rows that input partition p sends
to cell c, a part of a shard.  Given exact cell sizes, a uniform shuffle makes
row p multivariate hypergeometric, so the counts are drawn first, each
partition deals its rows to cells in random order (the local permutation), one
exchange moves them, and a second random order inside each cell gives slots.

No matrix is ever held: partition p's row is found by halving the range of
partitions and drawing the left half's share with a generator keyed by the
node, so all tasks agree and a rerun of a lost task draws the same numbers.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, extended, text_batches

#: Rows of a cell, which one task orders.
CELL_ROWS = 1_000_000
#: numpy draws hypergeometric counts from populations up to this size.
_NUMPY_LIMIT = 10**9


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, n * (good / total) * (bad / total)))
    a, b = max(low, int(mode - 14 * spread) - 20), min(high, int(mode + 14 * spread) + 20)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def _split(rng, cells: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn without replacement fall to each cell."""
    if cells.sum() < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    out, rest = np.zeros_like(cells), int(cells.sum())
    for i, size in enumerate(cells):
        rest -= int(size)
        out[i] = _hypergeometric(rng, int(size), rest, n) if n else 0
        n -= int(out[i])
    return out


def partition_row(prefix: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Partition p's row of the communication matrix."""
    lo, hi, cells = 0, len(prefix) - 1, cells.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | hi]))
        left = _split(rng, cells, int(prefix[mid] - prefix[lo]))
        if p < mid:
            hi, cells = mid, left
        else:
            lo, cells = mid, cells - left
    return cells


def even_sizes(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by at most one."""
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def _plain_read(df: DataFrame) -> bool:
    """Whether the plan but reads files or makes rows, so that each reading has the same rows in the same partitions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return set(re.findall(r"^[\s:+-]*([A-Z]\w*)", plan, re.M)) <= {"Project", "Filter", "Relation", "Range", "LocalRelation"}


def shuffle_to_shards(df: DataFrame, n_shards: int, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of ``df`` with ``shard`` and ``slot``: a uniform shuffle into shards at most one row apart.

    Columns of any name and content are carried along; columns called shard or
    slot are replaced.  Nulls, repeated rows and long texts are rows as any
    others.  An empty table gives an empty result.  Rows are counted by partition
    and then dealt from the same partitions: a plain read of files is read
    twice, anything else is written first.  A difference in numbers stops the
    job.
    """
    spark = df.sparkSession
    text_batches(spark)
    df = df.drop("shard", "slot")
    if not _plain_read(df):
        df = Scratch(spark, "shards").write(df, "rows")
    # One number for each input partition, as many as the driver has tasks to schedule.
    found = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    counts = np.zeros(max((r["p"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["p"]] = r["count"]
    total = int(counts.sum())
    prefix = np.concatenate([[0], np.cumsum(counts)])
    shards = even_sizes(total, n_shards)
    per_shard = max(1, math.ceil(total / n_shards / cell_rows))
    cells = np.concatenate([even_sizes(int(n), per_shard) for n in shards])
    shared = spark.sparkContext.broadcast((prefix, cells))

    schema = extended(df.schema, "__t_cell int, __t_order long, __t_at long")

    def deal(batches):
        prefix, cells = shared.value
        p, dealt, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if dealt is None:
                if p + 1 >= len(prefix):
                    raise RuntimeError("the input has other partitions than when it was counted")
                rng = np.random.Generator(np.random.Philox(key=[seed + 1, p]))
                dealt = rng.permutation(np.repeat(np.arange(len(cells), dtype=np.int32), partition_row(prefix, cells, p, seed)))
                order = rng.integers(0, 2**63 - 1, len(dealt))
            n = batch.num_rows
            if done + n > len(dealt):
                raise RuntimeError("the input has more rows than when it was counted")
            own = [pa.array(dealt[done : done + n]), pa.array(order[done : done + n]), pa.array(np.arange(done, done + n, dtype=np.int64) + (p << 33))]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "__t_cell", "__t_order", "__t_at"])
        if dealt is not None and done != len(dealt):
            raise RuntimeError("the input has fewer rows than when it was counted")

    shard = F.expr(f"cast(__t_cell div {per_shard} as int)")
    # The cells of a shard are even: the first ``size mod per_shard`` have one row more.
    size = F.lit(total // n_shards).cast("long") + F.when(shard < F.lit(total % n_shards), 1).otherwise(0)
    j = F.col("__t_cell") % per_shard
    starts = j * F.floor(size / per_shard) + F.least(j.cast("long"), size % per_shard)
    rank = F.row_number().over(Window.partitionBy("__t_cell").orderBy("__t_order", "__t_at"))
    return (
        df.mapInArrow(deal, schema)
        .withColumn("slot", (starts + rank - 1).cast("long"))
        .withColumn("shard", shard)
        .drop("__t_cell", "__t_order", "__t_at")
    )

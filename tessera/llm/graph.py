"""Classes of linked nodes, without all pairs of a group, and connected components.

Nodes that may be alike share buckets.  Each node goes home to the largest of
its buckets, homes are cut into chunks of bounded size, and a chunk is compared
in one task: homes are disjoint, so its classes need no component search.  One
member of each class then stands for it in the buckets of all its members, and
the same is done with these until no more classes join.  Last, in the buckets
that still hold several classes, every node outside of the largest is compared
with all members in blocks, so the classes are those of all pairs that share a
bucket and are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Nodes, and bytes of their bodies, that one task compares at once.
CHUNK, CHUNK_BYTES = 512, 16 << 20
#: Where less than this share of the nodes of a level join others, the rest is left to the last comparison.
FEW_JOINS = 0.05
#: Nodes of either side in one block of the last comparison.
OUTSIDE, INSIDE = 256, 1024
#: Bytes of bodies of whole groups that are handed over at once.
_GROUPS_BYTES = 2 << 20


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b): comp is the component's least node.

    Alternating star contraction: large stars link a node's larger neighbours
    to its least one, small stars its smaller ones, until all edges point at
    the least node.  Each round aggregates and joins by node, on tables only.
    """
    own = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = scratch.write(own, "edges")
    mark = _mark(own)
    while mark[0]:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = scratch.write(small.distinct(), "edges")
        scratch.drop(own, large)
        own, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return own.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def by_group(rows: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, groups_bytes: int) -> DataFrame:
    """``run`` on whole groups of ``rows``, many small ones at once: it gets a table, in order of node, and the bounds of the groups in it.

    A group must fit into memory; groups are streamed, not held together.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def whole(table: pa.Table, last: bool):
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for key in keys:
                column = table.column(key).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            bounds = np.flatnonzero(new)
            end = table.num_rows if last else int(bounds[-1])
            if last:
                bounds = np.append(bounds, end)
            out = run(table.slice(0, end), bounds).to_batches() if end else []
            return out, table.slice(end)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= groups_bytes:
                out, rest = whole(pa.Table.from_batches(held), False)
                yield from out
                # A copy, so that what has been handed over can go.
                held = rest.take(pa.array(np.arange(rest.num_rows))).combine_chunks().to_batches() if out else rest.to_batches()
                size = sum(b.nbytes for b in held) if out else 0
        if held:
            yield from whole(pa.Table.from_batches(held), True)[0]

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(stream, schema)


def _shared(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets of several nodes, with the bucket's nodes and bytes; the counts are written, so that a join can split a large bucket."""
    often = scratch.write(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "often")
    return members.join(often, "bucket")


def _homes(shared: DataFrame) -> DataFrame:
    """(node, size, home, chunk) of each node."""
    most = F.max_by(F.struct("bucket", "n", "bytes"), F.struct("n", "bucket")).alias("most")
    chunks = F.ceil(F.greatest(F.col("most.n") / CHUNK, F.col("most.bytes") / CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int")
    return shared.groupBy("node").agg(most, F.first("size").alias("size")).select("node", "size", F.col("most.bucket").alias("home"), chunk.alias("chunk"))


def link_groups(
    members: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    classes: Callable[[list[bytes], np.ndarray], np.ndarray],
    cross: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, Callable], tuple[np.ndarray, np.ndarray]],
    scratch: Scratch,
    groups_bytes: int = _GROUPS_BYTES,
    once: bool = False,
) -> DataFrame:
    """(node, comp) of the nodes of shared buckets, comp being a member of the class.

    ``members`` has (bucket, node, size), each pair once, size in bytes;
    ``fetch`` adds ``body`` to (node, size, home, chunk), repeating rows at will.
    ``classes`` gets bodies and the bounds of groups and gives each body the
    row of its class's member; ``cross`` gets bodies, bounds, marks of the rows
    that are to be compared with the others, numbers of classes, and a function
    of (a, b) that gives the pairs of rows of the group from a to b that no
    other block and no chunk has; it gives links between classes.  With
    ``once``, ``classes`` also gets the chunks, as pairs of arrays, in which the
    rows have been compared at the levels before, so that no pair of unlike
    members is compared again, and the last comparison leaves these out too.
    """

    def chunks_of(table: pa.Table, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(table.column(f"home{i}").to_numpy(), table.column(f"chunk{i}").to_numpy()) for i in range(levels)]

    def carried(levels: int) -> list[str]:
        return [f"{name}{i}" for i in range(levels) for name in ("home", "chunk")] if once else []

    def join_classes(table: pa.Table, bounds: np.ndarray, level: int) -> pa.Table:
        nodes = table.column("node").combine_chunks()
        new = np.ones(table.num_rows, bool)
        new[1:] = pc.not_equal(nodes.slice(1), nodes.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[bounds[:-1]] = True
        if not new.all():  # repeated rows
            table, bounds = table.filter(pa.array(new)), np.append(0, np.cumsum(new))[bounds]
        found = table.column("body").cast(pa.binary()).to_pylist()
        of = classes(found, bounds, chunks_of(table, level)) if once else classes(found, bounds)
        # The body goes on with the member that stands for the class.
        own = pa.array(of == np.arange(len(of)))
        bodies = pc.if_else(own, table.column("body"), pa.scalar(None, pa.string()))
        out = {"node": table.column("node"), "comp": table.column("node").take(pa.array(of)), "size": table.column("size"), "body": bodies}
        if once:
            out |= {f"home{level}": table.column("home"), f"chunk{level}": table.column("chunk")}
        return pa.table({name: table.column(name) for name in carried(level)} | out)

    def join_level(rows: DataFrame, level: int) -> DataFrame:
        kept = [f"{name} {'long' if name.startswith('home') else 'int'}" for name in carried(level)]
        own = [f"home{level} long", f"chunk{level} int"] if once else []
        joined = ", ".join([*kept, "node binary, comp binary, size long, body string", *own])
        return scratch.write(by_group(rows, ["home", "chunk"], partial(join_classes, level=level), joined, groups_bytes), "classes")

    shared = scratch.write(_shared(members, scratch), "members")
    bodies = scratch.write(fetch(_homes(shared)), "bodies")
    found, levels = join_level(bodies, 0), []
    comp = found.select("node", "comp")
    mixed = shared.select("bucket", "node")
    while True:
        # The members that stand for classes, in all buckets of these.
        own = mixed.join(found.select("node", "comp"), "node").select("bucket", F.col("comp").alias("node")).distinct()
        reps = found.where("body IS NOT NULL").select("node", "size", "body", *carried(len(levels) + 1))
        mixed = scratch.write(_shared(own.join(reps.select("node", "size"), "node"), scratch), "mixed")
        if mixed.isEmpty():
            return comp
        at = _homes(mixed).join(reps.drop("size"), "node")
        found = join_level(at, len(levels) + 1)
        levels.append(found)
        joins, nodes = found.agg(F.count_if(F.col("node") != F.col("comp")), F.count(F.lit(1))).first()
        if not joins:
            break
        after = found.select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
        comp = scratch.write(comp.join(after, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")), "comps")
        if joins < FEW_JOINS * nodes:
            break
    labelled = shared.select("bucket", "node").join(mixed.select("bucket").distinct(), "bucket").join(comp, "node")
    labelled = scratch.write(labelled, "labelled")
    # A pair of several buckets is compared in the least of them.
    of_node = bodies.select("node", "home", "chunk", "body").join(labelled.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node")
    # Members that stood for classes have been compared in chunks of later levels.
    for i, level in enumerate(levels if once else [], 1):
        of_node = of_node.join(level.select("node", f"home{i}", F.col(f"chunk{i}").alias("_chunk")), "node", "left")
        of_node = of_node.withColumn(f"home{i}", F.coalesce(f"home{i}", F.lit(0))).withColumn(f"chunk{i}", F.coalesce("_chunk", F.lit(-1))).drop("_chunk")
    sizes = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), (F.sum("n") - F.max("n")).alias("n_out"), F.sum("n").alias("n_all"))
    within = labelled.join(scratch.write(major, "major"), "bucket")
    rows, cols = F.ceil(F.col("n_out") / OUTSIDE), F.ceil(F.col("n_all") / INSIDE)
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    outside = F.col("comp") != F.col("major")
    # A node outside of the largest class stands in a row of blocks as outside, and in a column as all do.
    here = F.struct(F.array(block(rows, 11)).alias("i"), all_of(cols).alias("j"), F.lit(2).alias("side"))
    there = F.struct(all_of(rows).alias("i"), F.array(block(cols, 12)).alias("j"), outside.cast("int").alias("side"))
    blocks = within.select("bucket", "node", "comp", F.explode(F.when(outside, F.array(here, there)).otherwise(F.array(there))).alias("b"))
    blocks = blocks.select("bucket", "node", "comp", "b.side", "b.j", F.explode("b.i").alias("i")).select("bucket", "node", "comp", "side", "i", F.explode("j").alias("j"))

    later = range(1, len(levels) + 1) if once else range(0)

    def cross_links(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        comp = table.column("comp").combine_chunks().dictionary_encode()
        named, number = comp.dictionary, comp.indices.to_numpy().astype(np.int64)
        side = table.column("side").to_numpy()
        chunks = [_chunk_numbers(table.column(f"home{i}").to_numpy(), table.column(f"chunk{i}").to_numpy()) for i in ("", *later)]
        at, lists = table.column("bucket").to_numpy().tolist(), table.column("buckets").to_pylist()

        def pairs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            x, y = a + np.flatnonzero(side[a:b] == 2), a + np.flatnonzero(side[a:b] < 2)
            open_ = number[x][:, None] != number[y]
            for chunk in chunks:
                open_ &= chunk[x][:, None] != chunk[y]
            # Two nodes outside of the largest class meet twice; rows are in order of node.
            open_ &= (side[y] == 0) | (x[:, None] < y)
            i, j = np.nonzero(open_)
            x, y = x[i], y[j]
            smaller = {row: {other for other in lists[row] if other < at[a]} for row in np.unique(np.concatenate([x, y])).tolist()}
            here = np.fromiter((smaller[i].isdisjoint(smaller[j]) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))
            return x[here], y[here]

        a, b = cross(table.column("body").cast(pa.binary()).to_pylist(), bounds, side == 2, number, pairs)
        return pa.table({"a": named.take(pa.array(a, pa.int64())), "b": named.take(pa.array(b, pa.int64()))})

    links = blocks.join(of_node, "node")
    links = scratch.write(by_group(links, ["bucket", "i", "j"], cross_links, "a binary, b binary", groups_bytes), "links")
    if links.isEmpty():
        return comp
    after = components(links, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    return scratch.write(comp.join(after, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")), "comps")


def _chunk_numbers(home: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """A number for each chunk; rows of none, marked by a chunk below 0, have one of their own."""
    order = np.lexsort((chunk, home))
    new = np.ones(len(order), np.int64)
    new[1:] = (home[order][1:] != home[order][:-1]) | (chunk[order][1:] != chunk[order][:-1]) | (chunk[order][1:] < 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Joined:
    """Classes of the rows of one group, as pairs are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links = np.zeros(n, np.int64)
        self.done = np.zeros(n, bool)

    def next(self) -> int | None:
        """A row not yet compared, outside of the largest class: when there is none, all pairs across classes have been compared."""
        rows = self.next_rows(1)
        return int(rows[0]) if len(rows) else None

    def next_rows(self, most: int) -> np.ndarray:
        """Several such rows, at most so many."""
        largest = np.bincount(self.label).argmax()
        return np.flatnonzero((self.label != largest) & ~self.done)[:most]

    def pairs(self, rows: np.ndarray, chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of ``rows``, which are in order, with rows of other classes that have not been compared, nor in any of ``chunks``."""
        open_ = (self.label[rows][:, None] != self.label) & ~self.done
        for home, chunk in chunks:
            open_ &= (home[rows][:, None] != home) | (chunk[rows][:, None] != chunk)
        open_[:, rows] &= rows[:, None] < rows
        x, y = np.nonzero(open_)
        return rows[x], y

    def add_pairs(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """``rows`` have been compared with all others, and x are like y."""
        self.done[rows] = True
        self.add_links(x, y)

    def add_links(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows x are like y."""
        np.add.at(self.links, x, 1)
        for row in np.unique(x):
            labels = np.unique(self.label[np.append(y[x == row], row)])
            self.label[np.isin(self.label, labels)] = labels[0]

    def add(self, row: int, alike: np.ndarray) -> None:
        """``row`` has been compared with all others, and is like those."""
        self.done[row] = True
        self.links[row] = len(alike)
        labels = np.unique(self.label[np.append(alike, row)])
        self.label[np.isin(self.label, labels)] = labels[0]

    def members(self) -> np.ndarray:
        """For each row the row of its class that has the most links, the first of those."""
        order = np.lexsort((np.arange(len(self.label)), -self.links, self.label))
        first = np.flatnonzero(np.append(True, np.diff(self.label[order]) != 0))
        best = np.zeros(len(self.label), np.int64)
        best[self.label[order][first]] = order[first]
        return best[self.label]

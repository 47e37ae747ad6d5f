"""Fuzzy line deduplication.

Lines are normalised; equal normalised lines are one node.  A line's signature
is made of blocks: the SimHash of each run of seven words, of which the least
few are kept, and in a line of few words the SimHash of the others for each
word left out.  By the pigeonhole principle lines that differ in fewer places
than they have blocks share one, so lines are joined on blocks; pairs that meet
are verified by edit similarity alone, and one occurrence of each connected
group is kept.

The SimHash of a whole line is no use for this: where a word or two of a line
change, about 4 to 10 of its 64 bits do, and blocks of bits that allow for so
many are shared by unlike lines.
"""

from __future__ import annotations

import re
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edits import Codes
from .graph import Joined, link_groups
from .scratch import Scratch, text_batches
from .words import Words, byte_groups, mix

#: Edit similarity: one less the edit distance over the longer length.
SIMILARITY = 0.8
#: Blocks of runs of RUN words that a line's signature keeps.
RUN, BLOCKS = 7, 8
#: Lines of so many words at most also have a block for each word that is left out, and one of all words.
FEW_WORDS = 16
#: Bits of the map that tells which lines share a block: 16 MB, whatever the corpus; where it fills up, more lines are fetched than need be.
MAP_BITS = 1 << 27
#: Rows of a group that are compared in one round at most.
AT_ONCE = 64
#: Bytes of groups whose pairs are compared at once: many, as pairs of about the same length go together.
GROUPS_BYTES = 12 << 20
_SLICE = 1 << 20
#: Digits as 0, and what is no letter, digit or line feed as a space.
_PLAIN = bytes(b if b >= 0x80 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))
#: A character from U+3000 on: it counts as a word.
_WIDE = re.compile(rb"[\xe3-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: The bytes that no such character begins with.
_NARROW = bytes(range(0xE3))


def normalised_line(line):
    """Lower case; digits as 0; other runs of what is no letter or digit as one space."""
    plain = F.regexp_replace(F.lower(line), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def normalised_lines(text: str) -> list[bytes]:
    """``normalised_line`` of each line of a text, in UTF-8."""
    out = text.lower().encode().translate(_PLAIN)
    for run in (b"0", b" "):
        while run + run in out:
            out = out.replace(run + run, run)
    return out.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """SimHashes, of how often each bit is set in so many words."""
    return np.packbits(2 * counts > of[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(texts: list[bytes]) -> np.ndarray:
    """Each text's majority of the bits of its words' hashes; texts without words get 0."""
    words = Words(texts)
    counts = np.diff(words.bounds)
    out, some = np.zeros(len(texts), np.uint64), np.flatnonzero(counts)
    if len(some):
        sums = np.add.reduceat(_bits(mix(words.hashes)), words.bounds[:-1][some], axis=0, dtype=np.int64)
        out[some] = _majority(sums, counts[some])
    return out


def _run_simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of each seven words in a row: bits that four of them have, by adding bits three at a time."""

    def add(x, y, z):
        both = x ^ y
        return both ^ z, x & y | both & z

    n = max(0, len(hashes) - RUN + 1)
    a, b, c, d, e, f, g = (hashes[i : i + n] for i in range(RUN))
    (ones_1, twos_1), (ones_2, twos_2) = add(a, b, c), add(d, e, f)
    twos_3 = add(ones_1, ones_2, g)[1]
    # Four or more have a bit if two of the pairs do.
    return add(twos_1, twos_2, twos_3)[1]


def line_blocks(texts: list[bytes], blocks: int = BLOCKS, few: int = FEW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of the blocks of normalised lines, in order of the texts."""
    words = Words([_WIDE.sub(rb" \g<0> ", t) if t.translate(None, _NARROW) else t for t in texts])
    hashes, counts, bounds = mix(words.hashes), np.diff(words.bounds), words.bounds
    owner = np.repeat(np.arange(len(texts)), counts)
    runs = np.flatnonzero(owner[: 1 - RUN] == owner[RUN - 1 :])
    keys, own = mix(_run_simhash(hashes)[runs]), owner[runs]
    order = np.lexsort((keys, own)) if len(texts) >= 1 << 20 else np.argsort(keys >> np.uint64(20) | own.astype(np.uint64) << np.uint64(44))
    keys, own = keys[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
    keys, own = keys[new], own[new]
    first = np.searchsorted(own, np.arange(len(texts)))
    least = np.arange(len(own)) - first[own] < blocks
    out_own, out_keys = [own[least]], [keys[least]]
    short = np.flatnonzero((counts > 0) & (counts <= few))
    if len(short):
        # All words, and all but one.
        at = np.flatnonzero(np.isin(owner, short))
        bits, n = _bits(hashes[at]).astype(np.int16), counts[short]
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0)
        salted = lambda sig, n: mix(sig ^ mix(n.astype(np.uint64)))
        out_own.append(short)
        out_keys.append(salted(_majority(sums, n), n))
        rest = np.repeat(n, n) - 1
        some = np.flatnonzero(rest)
        out_own.append(owner[at][some])
        out_keys.append(salted(_majority((np.repeat(sums, n, axis=0) - bits)[some], rest[some]), rest[some]))
    return np.concatenate(out_own), np.concatenate(out_keys)


def _lines(batches, least_chars: int):
    """(batch, distinct normalised lines, their owners in the batch, numbers and place among the distinct ones)."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for part in byte_groups([len(t or "") for t in texts], _SLICE):
            owners, numbers, which, own = [], [], [], {}
            for i in range(part.start, part.stop):
                for number, line in enumerate(normalised_lines(texts[i] or "")):
                    if len(line) >= least_chars and (line.isascii() or len(line.decode()) >= least_chars):
                        owners.append(i)
                        numbers.append(number)
                        which.append(own.setdefault(line, len(own)))
            yield batch, list(own), owners, numbers, np.array(which, np.int64)


def _numbers(found: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(line) for line in found), np.uint64, len(found))


def shared_blocks(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """(bucket, own): the blocks that several lines share; ``own`` is a 64-bit hash of the line."""

    def scan(batches):
        for _, found, *_ in _lines(batches, least_chars):
            if found:
                owner, keys = line_blocks(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(_numbers(found)[owner].view(np.int64))], names=["bucket", "own"])

    def shared(batches):
        """Rows in order of both: distinct ones that have another of their bucket; only the last distinct one is held."""
        last, last_shared = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, own = (c.to_numpy() for c in batch.columns)
            if last is not None:
                buckets, own = np.append(last[0], buckets), np.append(last[1], own)
            new = np.ones(len(own), bool)
            new[1:] = (buckets[1:] != buckets[:-1]) | (own[1:] != own[:-1])
            buckets, own = buckets[new], own[new]
            like_next = buckets[1:] == buckets[:-1]
            some = np.append(like_next, False) | np.append(last_shared, like_next)
            last, last_shared = (buckets[-1:], own[-1:]), bool(some[-1])
            yield pa.RecordBatch.from_arrays([pa.array(buckets[:-1][some[:-1]]), pa.array(own[:-1][some[:-1]])], names=["bucket", "own"])
        if last is not None and last_shared:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["bucket", "own"])

    schema = "bucket long, own long"
    return docs.select(F.col(text).alias("t")).mapInArrow(scan, schema).repartition("bucket").sortWithinPartitions("bucket", "own").mapInArrow(shared, schema)


def _map_of(buckets: DataFrame) -> np.ndarray:
    """The bits of all lines that share a block, in MAP_BITS."""
    bit = F.pmod(F.col("own"), F.lit(MAP_BITS))
    words = buckets.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(own, {MAP_BITS}L), 64L) as int))")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def judged_lines(docs: DataFrame, text: str, row_id: str, least_chars: int, shared_map: np.ndarray) -> DataFrame:
    """(id, line_no, node, own, norm) of the lines that are long enough; of equal lines of one batch that share a block the first has ``own`` and ``norm``."""
    sent = docs.sparkSession.sparkContext.broadcast(shared_map)

    def scan(batches):
        bits = sent.value
        for batch, found, owners, numbers, which in _lines(batches, least_chars):
            own = _numbers(found)
            at = own % np.uint64(MAP_BITS)
            shares = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            firsts = np.unique(which, return_index=True)[1]
            norms, hashes = np.full(len(which), None, object), np.full(len(which), None, object)
            norms[firsts[shares]] = [found[i] for i in shares]
            hashes[firsts[shares]] = own[shares].view(np.int64).tolist()
            nodes = pa.array([md5(line, usedforsecurity=False).digest() for line in found], pa.binary())
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), nodes.take(pa.array(which)), pa.array(hashes, pa.int64()), pa.array(norms, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "line_no", "node", "own", "norm"])

    own = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("t"))
    return own.mapInArrow(scan, "id long, line_no int, node binary, own long, norm string")


def _distance(x: str, y: str, most: int) -> int:
    """Edit distance by bit vectors as long as x, which is no longer than y (Myers 1999); beyond ``most`` any number over it.

    A path to the end costs no less than the cell of the last diagonal in any
    column, which ends the search early.
    """
    if not x:
        return len(y)
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(x)) - 1
    up, down, less = every, 0, len(x) - len(y)
    for j, c in enumerate(y, 1):
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(diagonal | up)), up & diagonal
        right_up = (right_up << 1 | 1) & every
        down, up = right_up & diagonal, (right_down << 1 & every) | (every & ~(diagonal | right_up))
        if not j % 16 and j + less > 0:
            below = (1 << j + less) - 1
            if (distance := j + (up & below).bit_count() - (down & below).bit_count()) > most:
                return distance
    return len(y) + up.bit_count() - down.bit_count()


def _by_passages(x: str, y: str, most: int) -> bool:
    """Whether ``most`` edits do if what lies between passages in common is replaced; if not, fewer edits may do otherwise."""
    i, j, cost = 0, 0, 0
    while cost <= most and i < len(x) and j < len(y):
        for step in (64, 8):
            while x[i : i + step] == y[j : j + step] and i < len(x):
                i, j = i + step, j + step
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
        if i >= len(x) or j >= len(y):
            break
        for skipped in range(1, 64):
            if (at := y.find(x[i + skipped : i + skipped + 12], j, j + skipped + 64)) >= 0:
                break
        else:
            return False
        i, j, cost = i + skipped, at, cost + max(skipped, at - j)
    return cost + max(len(x) - i, len(y) - j, 0) <= most


def near(x: str, y: str, most: int) -> bool:
    """Whether passages in common show that the edit distance is at most ``most``."""
    return _by_passages(*sorted((x, y), key=len), most)


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; what both have in common at either end is cut first."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > most:
        return False
    head = 0
    while head < len(x) and x[head] == y[head]:
        head += 1
    x, y = x[head:], y[head:]
    tail = 0
    while tail < len(x) and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if len(y) <= most:
        return True
    # Lines that are unlike mostly are so far apart after two edits' worth of characters for each allowed one.
    part, less = 2 * most + 16, len(x) - len(y)
    if 2 * part < len(y) + part and part + less > 0 and _distance(x[: part + less], y[:part], most) > most:
        return False
    return _distance(x, y, most) <= most


class _Table:
    """Normalised lines, decoded once."""

    def __init__(self, bodies: list[bytes]):
        self.texts = [b.decode() for b in bodies]
        self.codes = Codes(self.texts)
        self.lengths = self.codes.lengths

    def alike(self, rows: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the pairs have the edit similarity."""
        out, open_ = self.told(rows, others, similarity)
        out[open_] = self.exactly(rows[open_], others[open_], similarity)
        return out

    def _most(self, rows: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
        return np.floor((1 - similarity) * np.maximum(self.lengths[rows], self.lengths[others]) + 1e-9).astype(np.int64)

    def told(self, rows: np.ndarray, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are seen to have the edit similarity without a table of edits, and the places of those that are left open."""
        most, out = self._most(rows, others, similarity), np.zeros(len(rows), bool)
        some = np.flatnonzero(np.abs(self.lengths[rows] - self.lengths[others]) <= most)
        some = some[~self.codes.far(rows[some], others[some], most[some])]
        out[some] = [near(self.texts[x], self.texts[y], m) for x, y, m in zip(rows[some].tolist(), others[some].tolist(), most[some].tolist())]
        some = some[~out[some]]
        return out, some[~self.codes.apart(rows[some], others[some], most[some])]

    def exactly(self, rows: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the pairs have the edit similarity, by tables of edits."""
        return self.codes.within(rows, others, self._most(rows, others, similarity), lambda x, y, m: within(self.texts[x], self.texts[y], m))


def _classes(bodies: list[bytes], bounds: np.ndarray, chunks: list = (), *, similarity: float) -> np.ndarray:
    """Rows of all groups are compared in rounds; a group takes more rows at once after a round that joined few.

    What a round leaves open is compared last, all at once, where it still is across classes.
    """
    table, out = _Table(bodies), np.arange(len(bodies))
    starts, sizes = bounds[:-1], np.diff(bounds)
    two = starts[sizes == 2]
    for home, chunk in chunks:
        two = two[(home[two] != home[two + 1]) | (chunk[two] != chunk[two + 1])]
    like, open_two = table.told(two, two + 1, similarity)
    out[two[like] + 1] -= 1
    left = [(two[open_two], two[open_two] + 1)]
    open_ = [(a, Joined(n), 1) for a, n in zip(starts.tolist(), sizes.tolist()) if n > 2]
    done = []
    while open_:
        pairs, asked = [], []
        for group in open_:
            a, joined, at_once = group
            if len(rows := joined.next_rows(at_once)):
                x, y = joined.pairs(rows, [(home[a : a + len(joined.label)], chunk[a : a + len(joined.label)]) for home, chunk in chunks])
                pairs.append((a + x, a + y))
                asked.append((group, rows, x, y))
            else:
                done.append(group)
        if not asked:
            break
        both = tuple(np.concatenate(p) for p in zip(*pairs))
        alike, unsure = table.told(*both, similarity)
        left.append(tuple(p[unsure] for p in both))
        open_, end = [], 0
        for (a, joined, at_once), rows, x, y in asked:
            like = alike[end : end + len(x)]
            end += len(x)
            joined.add_pairs(rows, x[like], y[like])
            open_.append((a, joined, at_once if 8 * np.count_nonzero(like) > len(like) else min(2 * at_once, AT_ONCE)))
    label = out.copy()
    for a, joined, _ in done:
        label[a : a + len(joined.label)] = a + joined.label
    x, y = (np.concatenate(p) for p in zip(*left))
    across = label[x] != label[y]
    x, y = x[across], y[across]
    like = table.exactly(x, y, similarity)
    x, y = x[like], y[like]
    pairs_of_two = sizes[np.searchsorted(starts, x, side="right") - 1] == 2
    out[y[pairs_of_two]] -= 1
    x, y = x[~pairs_of_two], y[~pairs_of_two]
    for a, joined, _ in done:
        n = len(joined.label)
        here = (x >= a) & (x < a + n) if len(x) else ()
        if np.any(here):
            joined.add_links(x[here] - a, y[here] - a)
        out[a : a + n] = a + joined.members()
    return out


def _cross(bodies: list[bytes], bounds: np.ndarray, outside: np.ndarray, comps: np.ndarray, pairs, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """What is left open is compared where no pair is known to link the same classes."""
    table = _Table(bodies)
    x, y = (np.concatenate(p) for p in zip(*(pairs(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))))
    like, left = table.told(x, y, similarity)
    link = np.minimum(comps[x], comps[y]) * len(bodies) + np.maximum(comps[x], comps[y])
    left = left[~np.isin(link[left], link[like])]
    like[left] = table.exactly(x[left], y[left], similarity)
    links = np.unique(link[like])
    return links // len(bodies), links % len(bodies)


def _judge(docs: DataFrame, text: str, row_id: str, similarity: float, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, line_no, node) of all judged lines, and (node, class, keep, at) of the nodes that are repeated or linked."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    buckets = scratch.write(shared_blocks(docs, text, least_chars), "buckets")
    judged = scratch.write(judged_lines(docs, text, row_id, least_chars, _map_of(buckets)), "judged")
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "line_no")
    has_norm = F.col("norm").isNotNull()
    nodes = judged.groupBy("node").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.max(F.octet_length("norm")).cast("long").alias("size"), F.min(F.when(has_norm, at)).alias("at"))
    nodes = scratch.write(nodes, "nodes")
    members = buckets.join(nodes.where("own IS NOT NULL").select("own", "node", "size"), "own").select("bucket", "node", "size")

    def fetch(homes: DataFrame) -> DataFrame:
        """Of the rows that have a node's text, that with the least id and line, so a line of many documents is one row."""
        keys = lambda row: (F.coalesce(row("id"), F.lit(0)).alias("_id"), row("line_no").alias("_line"))
        picked = homes.join(nodes.select("node", *keys(lambda c: F.col(f"at.{c}"))), "node").hint("shuffle_hash")
        return judged.where(has_norm).select("node", *keys(F.col), F.col("norm").alias("body")).join(picked, ["node", "_id", "_line"]).drop("_id", "_line")

    comp = link_groups(members, fetch, partial(_classes, similarity=similarity), partial(_cross, similarity=similarity), scratch, GROUPS_BYTES, once=True)
    # A line that occurs once and has no link is kept; the others are looked up.
    of_node = nodes.select("node", "first", "n").join(comp, "node", "left").where("n > 1 OR comp IS NOT NULL").withColumn("class", F.coalesce("comp", "node"))
    # Equal rows of ``first`` are repeated rows of one document.
    of_class = of_node.groupBy("class").agg(F.min(F.struct("first", "node")).alias("least"), F.min("node").alias("name"))
    by_node = of_node.join(of_class, "class").select("node", F.col("name").alias("class"), (F.col("node") == F.col("least.node")).alias("keep"), F.col("least.first").alias("at"))
    return judged.select("id", "line_no", "node"), by_node


def _kept():
    return F.col("keep") & F.col("id").eqNullSafe(F.col("at.id")) & (F.col("line_no") == F.col("at.line_no"))


def fuzzy_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", similarity: float = SIMILARITY, least_chars: int = 1) -> DataFrame:
    """(row_id, line_no, node, class, kept) of every line that is judged.

    Lines are judged if they have ``least_chars`` characters once normalised,
    by default all that are not empty; those of null and empty texts are not.
    ``node`` is the MD5 of the normalised line, ``class`` the least node of its
    connected group.  Of each class the occurrence with the smallest id (nulls
    last), then the first line, is kept.  Rows that are repeated with the same
    id are one document: what is kept in one of them is kept in all.  Long
    lines are taken whole.  An empty table gives an empty result.
    """
    judged, by_node = _judge(docs, text, row_id, similarity, least_chars)
    lines = judged.join(by_node, "node", "left")
    lines = lines.withColumn("kept", F.when(F.col("class").isNull(), True).otherwise(_kept())).withColumn("class", F.coalesce("class", "node"))
    return lines.select(F.col("id").alias(row_id), "line_no", "node", "class", "kept")


def _dropped(judged: DataFrame, by_node: DataFrame) -> DataFrame:
    """(__t_id, __t_drop): the numbers of the lines that go, of the ids that have any."""
    return judged.join(by_node, "node").where(~_kept()).groupBy(F.col("id").alias("__t_id")).agg(F.array_sort(F.collect_set("line_no")).alias("__t_drop"))


def drop_fuzzy_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", similarity: float = SIMILARITY, least_chars: int = 1) -> DataFrame:
    """``docs`` with the lines that ``fuzzy_lines`` does not keep cut from the text; null texts stay null, and columns of any name as they were."""
    dropped = Scratch(docs.sparkSession, "lines").write(_dropped(*_judge(docs, text, row_id, similarity, least_chars)), "dropped")
    joined = docs.join(dropped, F.col(row_id).cast("long").eqNullSafe(F.col("__t_id")), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("__t_drop", i))
    return joined.withColumn(text, F.when(F.col("__t_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__t_id", "__t_drop")


def line_digest(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """For each row: n_lines, n_judged, n_dropped and the numbers of the dropped lines, comma-joined.

    All lines that are not empty once normalised are judged.  A null text is
    one empty line; rows repeated with the same id have n_judged of all of
    them; of null ids, too.  An empty table gives an empty result.
    """
    totals = docs.select(F.col(row_id).cast("long").alias(row_id), (F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))), F.lit(0)) + 1).cast("long").alias("n_lines"))
    judged, by_node = _judge(docs, text, row_id, SIMILARITY, 1)
    counts = judged.groupBy(F.col("id").alias("__t_id")).agg(F.count(F.lit(1)).alias("n_judged"))
    found = counts.join(_dropped(judged, by_node).select(F.col("__t_id").alias("__t_of"), "__t_drop"), F.col("__t_id").eqNullSafe(F.col("__t_of")), "left")
    joined = totals.join(found, totals[row_id].eqNullSafe(found["__t_id"]), "left")
    numbers = F.array_join(F.transform("__t_drop", lambda x: x.cast("string")), ",")
    return joined.select(row_id, "n_lines", F.coalesce("n_judged", F.lit(0)).alias("n_judged"), F.coalesce(F.size("__t_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(numbers, F.lit("")).alias("dropped_lines"))

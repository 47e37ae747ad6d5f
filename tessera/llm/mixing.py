"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document d of source s and length class c gets the rate most / (1 + exp(-a_s -
b_c)): its odds of being taken are exponentially tilted.  These are the rates
nearest to even odds in relative entropy, weighed by size, so that the words
taken of each source make its target, and those of each length class (a power
of two of words) keep the share that the class has in the corpus; as sources
differ in length, one rate for each source does not do that.  The classes'
constraints give way by RIDGE times b, so there always is a solution.  Sources
whose target is their limit are taken whole.

The convex dual is solved by Newton steps: each sums values and derivatives
over cells of (source, class), eliminates the sources, each on its own, and
leaves a system of as many unknowns as there are length classes, 64 at most,
whose solution the driver sends back to all sources.

Rates become copies by systematic rounding along size: walking a source's
documents by size, a copy is due whenever the running sum of rates passes a
whole number, so copies and rates never part by more than one document; single
copies then settle what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

NOT_SPACE = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: How far a length class's words may be off, as a share of its target for each unit of its multiplier.
RIDGE = 0.01
#: Newton steps end when nothing is off by this share of its target.
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Parts of the documents of a source and length class, of each of which two may have a copy more or less in the end.
OFFERS = 16
#: The longest step of a multiplier.
_STEP = 2.0
#: (source, size) steps that one task walks in order.
WALK_ROWS = 200_000


def word_sizes(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long"))


def water_fill(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn.  Stopping a
    target at its limit and sharing the excess until none is above ends at one
    level t with targets min(limit, weight * t); sources reach their limits in
    the order of limit / weight, so t is found from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = sources.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * most)
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(1))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        full.withColumn("_level", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(all_) * share)
        .withColumn("_stopped", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        # The level if all sources before this one have stopped and this and the later ones have not.
        # It holds where this one indeed stays below its limit; of those levels the first is the largest.
        .withColumn("_t", (F.col("_total") - F.col("_stopped")) / F.col("_open"))
        .withColumn("_t", F.max(F.when(F.col("_t") <= F.col("_level"), F.col("_t"))).over(all_))
    )
    target = F.when(F.col("_t").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_weight") * F.col("_t")))
    return level.select("source", "source_size", target.alias("target"))


def length_class(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def solve_rates(stats: DataFrame, targets: DataFrame, scratch: Scratch, most: float = MOST, ridge: float = RIDGE, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[int, float]]:
    """(source, class, rate) of each cell, and the multipliers of the length classes, by Newton's method on the dual.

    ``stats`` is (source, size, n) with sizes over 0, ``targets`` (source,
    source_size, target).  Sources without words or with target 0 get no rate.
    """
    words = stats.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("words"))
    c, t = words.alias("c"), targets.where("target > 0").alias("t")
    limit = F.col("t.source_size") * most
    cells = c.join(t, F.expr("c.source <=> t.source")).select("c.source", "c.class", "c.words", "t.target", limit.alias("limit"), (F.col("t.target") >= limit * (1 - 1e-12)).alias("whole"))
    cells = scratch.write(cells, "cells")
    state = cells.where("NOT whole").select("source", F.log(F.col("target") / (F.col("limit") - F.col("target"))).alias("a")).distinct()
    state = scratch.write(state, "state")
    # Of each class the share in the corpus, of all that the open sources give.
    by_class = {r["class"]: r["words"] for r in words.groupBy("class").agg(F.sum("words").alias("words")).collect()}
    open_classes = sorted(r["class"] for r in cells.where("NOT whole").select("class").distinct().collect())
    total = cells.where("NOT whole").select("source", "target").distinct().agg(F.sum("target")).first()[0]
    at = {k: i for i, k in enumerate(open_classes)}
    of_open = sum(by_class[k] for k in open_classes)
    goal = np.array([by_class[k] / of_open * total for k in open_classes])
    b = np.zeros(len(at))
    tilted = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, i in at.items() for x in (k, float(values[i]))]), F.col("class"))
    rate = lambda b: most / (1 + F.exp(-F.col("a") - tilted(b)))
    for _ in range(MAX_STEPS if at else 0):
        c, s = cells.where("NOT whole").alias("c"), state.alias("s")
        x = c.join(s, F.expr("c.source <=> s.source")).select("c.source", "c.target", "c.class", "c.words", "s.a")
        x = x.withColumn("r", rate(b)).withColumn("w", F.expr("words * r")).withColumn("h", F.col("w") * (1 - F.col("r") / most))
        per = x.groupBy("source", "target", "a").agg(F.sum("w").alias("w"), F.sum("h").alias("h"), F.collect_list(F.struct("class", "w", "h")).alias("of"))
        per = scratch.write(per.withColumn("g", F.col("w") - F.col("target")), "sources")
        # For two classes what the elimination of the sources leaves; for one its words, slope and what the sources lack.
        pairs = F.expr("flatten(transform(of, x -> transform(of, y -> struct(x.class as i, y.class as j, 0 as kind, -x.h * y.h / h as v))))")
        ones = F.expr("flatten(transform(of, x -> array(struct(x.class as i, x.class as j, 1 as kind, x.w as v), struct(x.class as i, x.class as j, 0 as kind, x.h as v), struct(x.class as i, x.class as j, 2 as kind, x.h * g / h as v))))")
        sums = per.select(F.explode(F.concat(pairs, ones)).alias("e")).groupBy("e.i", "e.j", "e.kind").agg(F.sum("e.v").alias("v")).collect()
        slopes, given, lacking = np.zeros((len(at), len(at))), np.zeros(len(at)), np.zeros(len(at))
        for i, j, kind, v in sums:
            if kind == 0:
                slopes[at[i], at[j]] += v
            else:
                (given if kind == 1 else lacking)[at[i]] += v
        off = given - goal + ridge * goal * b
        step = np.linalg.solve(slopes + np.diag(ridge * goal), lacking - off)
        step *= min(1.0, _STEP / max(np.abs(step).max(), 1e-300))
        moved = F.expr("-g") - F.aggregate(F.transform("of", lambda x: x["h"] * F.element_at(F.create_map(*[F.lit(v) for k, i in at.items() for v in (k, float(step[i]))]), x["class"])), F.lit(0.0), lambda s, v: s + v)
        new = per.select("source", (F.col("a") + F.greatest(F.lit(-_STEP), F.least(F.lit(_STEP), moved / F.col("h")))).alias("a"), (F.abs("g") / F.col("target")).alias("off"))
        before, state = state, scratch.write(new, "state")
        b = b + step
        scratch.drop(before, per)
        if state.agg(F.max("off")).first()[0] < tolerance and np.abs(off).max() < tolerance * total:
            break
    c, s = cells.alias("c"), state.alias("s")
    solved = c.where("NOT whole").join(s, F.expr("c.source <=> s.source")).select("c.source", "c.class", "s.a") if at else None
    rates = cells.where("whole").select("source", "class", F.lit(float(most)).alias("rate"))
    if solved is not None:
        rates = rates.unionByName(solved.select("source", "class", rate(b).alias("rate")))
    return scratch.write(rates, "rates"), {k: float(b[i]) for k, i in at.items()}


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, walk_rows: int = WALK_ROWS) -> DataFrame:
    """Every row of ``df`` with size, source_size, target, copies and taken.

    Copies of a row are at most ``most`` rounded up in whole documents; with
    ``most`` 2 no document is taken more than twice.  Null and empty texts have
    size 0 and no copies; a source of none but such has target 0; a null
    source is a source, the last.  Ties of size are broken by a hash of the id
    and then by the number of the row in ties, so reruns agree; repeated rows
    with the same id share whatever copies fall to them, in some order.  Other
    columns are carried along, those named as the new ones are replaced; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    df = word_sizes(df.drop("size", "source_size", "target", "copies", "taken"), text)
    narrow = scratch.write(df.select(F.col(source).alias("source"), F.col(row_id).alias("id"), "size"), "sizes")
    stats = scratch.write(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "stats")
    targets = scratch.write(water_fill(stats.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, most), "targets")
    positive = stats.where("size > 0")
    rates, _ = solve_rates(positive, targets, scratch, most)
    copies = _round(narrow.where("size > 0"), positive, rates, targets, scratch, most, walk_rows)
    d, t = df.alias("d"), targets.alias("t")
    with_target = d.join(t, F.col(f"d.{source}").eqNullSafe(F.col("t.source"))).select("d.*", F.col("t.source_size"), F.col("t.target"))
    keyed = with_target.withColumns({"__t_s": F.col(source), "__t_i": F.col(row_id)})
    # Rows alike in source, id and size get their copies one by one.
    turn = F.row_number().over(Window.partitionBy("__t_s", "__t_i", "size").orderBy(F.lit(1)))
    c = copies.alias("c")
    joined = keyed.withColumn("__t_turn", turn).alias("k").join(c, F.expr("k.__t_s <=> c.source and k.__t_i <=> c.id and k.size = c.size and k.__t_turn = c.turn"), "left")
    names = [n for n in with_target.columns]
    return joined.select(*[F.col(f"k.`{n}`") for n in names], F.coalesce("c.copies", F.lit(0)).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def _round(narrow: DataFrame, stats: DataFrame, rates: DataFrame, targets: DataFrame, scratch: Scratch, most: float, walk_rows: int) -> DataFrame:
    """(source, id, size, turn) with whole copies.

    All documents of one source and size have one rate, so the running sum of
    rates before a document is the sum over smaller sizes, which is taken over
    ``stats``, plus rate times the number of its equals before it.
    """
    s, r = stats.alias("s"), rates.alias("r")
    same = F.col("s.source").eqNullSafe(F.col("r.source")) & (length_class(F.col("s.size")) == F.col("r.class"))
    sizes = scratch.write(s.join(r, same).select("s.source", "s.size", "s.n", "r.rate"), "sizes")
    # Running sums in two levels: over ranges of sizes, and inside a range.
    spread = F.floor(F.log2("size") * 64).cast("int")
    ranged = sizes.withColumn("_range", spread)
    ranges = ranged.groupBy("source", "_range").agg(F.sum(F.expr("n * rate")).alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0))).drop("_sum")
    inside = Window.partitionBy("source", "_range").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    x, y = ranged.withColumn("_in", F.coalesce(F.sum(F.expr("n * rate")).over(inside), F.lit(0.0))).alias("x"), ranges.alias("y")
    based = x.join(y, F.expr("x.source <=> y.source and x._range = y._range")).select("x.source", "x.size", "x.n", "x.rate", (F.col("y._base") + F.col("x._in")).alias("base"))
    # Number the documents of one source and size by a hash of their ids; a common size is cut into salted parts.
    p = narrow.alias("p").join(based.alias("q"), F.expr("p.source <=> q.source and p.size = q.size")).select("p.source", "p.id", "p.size", "q.rate", "q.base", "q.n")
    p = p.withColumn("_h", F.xxhash64("id", F.lit(17)))
    p = scratch.write(p.withColumn("_part", F.pmod(F.shiftright("_h", 20), F.ceil(F.col("n") / walk_rows)).cast("int")), "numbered")
    parts = p.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).drop("_m")
    at = Window.partitionBy("source", "size", "_part").orderBy("_h", "id")
    p = p.withColumn("_k", F.row_number().over(at) - 1).withColumn("turn", F.row_number().over(Window.partitionBy("source", "size", "_part", "_h", "id").orderBy("_k")))
    j = p.alias("p").join(parts.alias("q"), F.expr("p.source <=> q.source and p.size = q.size and p._part = q._part"))
    sum_before = F.col("p.base") + F.col("p.rate") * (F.col("p._k") + F.col("q._skip"))
    # A half keeps sums that are whole numbers but for rounding from flipping.
    due = F.floor(sum_before + F.col("p.rate") + 0.5) - F.floor(sum_before + 0.5)
    rounded = scratch.write(j.select("p.source", "p.id", "p.size", "p.turn", F.least(due, F.lit(int(most))).cast("int").alias("copies")), "rounded")
    # What the first pass oversteps by less than it lacked, the second settles the other way.
    return _settle(scratch.write(_settle(rounded, targets, most), "settled"), targets, most)


def _settle(rounded: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Bring each source's words closer to its target by single copies, largest first.

    What rounding leaves is at most about one document's size.  Of the
    documents that can have one copy more (or less), up to 2 * OFFERS for each
    power of two of sizes are offered, and taken in descending size where they
    still fit; last the one that comes closest, if that is closer.
    """
    taken = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    r, t = taken.alias("r"), targets.alias("t")
    rest = r.join(t, F.expr("r.source <=> t.source")).select("r.source", (F.col("t.target") - F.col("r.taken")).alias("rest"))
    x, r = rounded.alias("x"), rest.alias("r")
    one = F.struct("size", "id", "turn")
    offers = (
        x.join(r, F.expr("x.source <=> r.source"))
        .select("x.source", "x.id", "x.size", "x.turn", "x.copies", "r.rest")
        .where((F.col("size") < 2 * F.abs("rest")) & F.when(F.col("rest") > 0, F.col("copies") < int(most)).otherwise(F.col("copies") > 0))
        .groupBy("source", "rest", length_class(F.col("size")).alias("_power"), F.pmod(F.xxhash64("id", "turn", F.lit(29)), F.lit(OFFERS)).alias("_salt"))
        .agg(F.min(one).alias("low"), F.max(one).alias("high"))
        .groupBy("source", "rest")
        .agg(F.reverse(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("low", "high")))))).alias("offers"))
    )
    start = F.struct(F.abs("rest").alias("rest"), F.slice("offers", 1, 0).alias("chosen"))
    step = lambda s, o: F.when(o["size"] <= s["rest"], F.struct((s["rest"] - o["size"]).alias("rest"), F.concat(s["chosen"], F.array(o)).alias("chosen"))).otherwise(s)
    folded = offers.withColumn("_end", F.aggregate("offers", start, step)).select("source", F.signum("rest").cast("int").alias("change"), F.col("_end.rest").alias("left"), F.col("_end.chosen").alias("chosen"), F.array_except("offers", "_end.chosen").alias("others"))
    closest = F.array_min(F.transform("others", lambda o: F.struct(F.abs(o["size"] - F.col("left")).alias("off"), o.alias("o"))))
    last = F.when(closest["off"] < F.col("left"), F.array(closest["o"])).otherwise(F.slice("others", 1, 0))
    chosen = folded.select("source", "change", F.explode(F.concat("chosen", last)).alias("o")).select("source", "change", "o.*")
    x, c = rounded.alias("x"), chosen.alias("c")
    same = F.expr("x.source <=> c.source and x.id <=> c.id and x.size = c.size and x.turn = c.turn")
    return x.join(c, same, "left").select("x.source", "x.id", "x.size", "x.turn", (F.col("x.copies") + F.coalesce("c.change", F.lit(0))).alias("copies"))

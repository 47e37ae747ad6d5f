"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The fixed patterns find seeds.  The words around seeds are lexical patterns:
one on either side, two before, or two after.  A looser shape finds candidates,
which share instances and patterns with the seeds in a graph.  Scores pass to
and fro until they rest: a pattern is as good as all that it surrounds, seeds
of other kinds counting against it; an instance as its patterns together.
Confident instances induce further patterns, until none are new.  Candidates
that patterns of high confidence surround are added to the spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch, extended, text_batches

KINDS = ("email", "ip", "card", "phone")
#: Patterns and instances count from this score on.
CONFIDENCE = 0.8
#: A pattern needs so many different seeds of its kind.
SUPPORT = 3
#: Scores rest when none changes by more; rounds of scores and of new patterns at most.
TOLERANCE = 0.005
ROUNDS, INDUCTIONS = 40, 5

# The base patterns.  Possessive quantifiers and the look-behinds
# only spare vain attempts; matches are those of the plain patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Candidates: digits in groups, and addresses that spell out the at.
_LOOSE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])|[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]+)+")
_AROUND = 60


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, so that long words without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if start < at:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a find, lower-cased, digits as 0: those that have a letter."""
    plain = lambda words: [re.sub(r"[0-9]", "0", w.lower()) for w in words]
    before, after = plain(text[max(0, start - _AROUND) : start].split()[-2:]), plain(text[end : end + _AROUND].split()[:2])
    out = []
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return [c for c in out if any(x.isalpha() for x in c)]


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that spans cover, in order."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def digest(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Every row of ``docs`` with base (spans of the fixed patterns) and added spans.

    Both are arrays of (kind, start, end) in code points, end exclusive, by
    start and then kind.  Null texts count as empty and have none.  A candidate
    that overlaps a base span is no candidate.  Repeated rows are judged alike.
    Other columns are carried along, those named base or added are replaced; an
    empty table gives an empty result.  The text goes into no table that is
    written but as the words next to a find.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.drop("base", "added")
    scratch = Scratch(spark, "personal")
    span = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    seed = pa.struct([("kind", pa.string()), ("ctx", pa.list_(pa.string())), ("value", pa.string())])
    loose = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("ctx", pa.list_(pa.string())), ("value", pa.string())])
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = extended(StructType(rest), "base array<struct<kind:string,a:long,b:long>>, __t_seeds array<struct<kind:string,ctx:array<string>,value:string>>, __t_loose array<struct<a:long,b:long,ctx:array<string>,value:string>>")
    source = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(text).alias("__t_text"))

    def scan(batches):
        for batch in batches:
            every = ([], [], [])
            for t in batch.column(batch.num_columns - 1).to_pylist():
                t = t or ""
                base = base_spans(t)
                seeds = [{"kind": k, "ctx": c, "value": _value(t[a:b])} for k, a, b in base if (c := contexts(t, a, b))]
                found = []
                starts, ends = _merged(base)
                for m in _LOOSE.finditer(t):
                    a, b = m.span()
                    i = bisect(starts, b - 1)
                    if not (i and ends[i - 1] > a) and (c := contexts(t, a, b)):
                        found.append({"a": a, "b": b, "ctx": c, "value": _value(m[0])})
                for column, rows in zip(every, ([{"kind": k, "a": a, "b": b} for k, a, b in base], seeds, found)):
                    column.append(rows)
            own = [pa.array(c, pa.list_(kind)) for c, kind in zip(every, (span, seed, loose))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*[f.name for f in rest], "base", "__t_seeds", "__t_loose"])

    scanned = scratch.write(source.mapInArrow(scan, schema).withColumn("__t_row", F.expr("uuid()")), "scanned")
    good = _good_candidates(scanned, scratch, confidence, support)
    found = scanned.select("__t_row", F.explode("__t_loose").alias("c")).select("__t_row", "c.a", "c.b", "c.value", F.explode("c.ctx").alias("ctx"))
    added = (
        found.join(good, ["ctx", "value"])
        .groupBy("__t_row")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("a"), F.col("b"), F.col("kind")))).alias("__t_added"))
        .select("__t_row", F.transform("__t_added", lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b"))).alias("added"))
    )
    none = F.array().cast("array<struct<kind:string,a:long,b:long>>")
    return scanned.join(added, "__t_row", "left").withColumn("added", F.coalesce("added", none)).drop("__t_row", "__t_seeds", "__t_loose")


def _value(found: str) -> str:
    """An instance as a node: its digits, or its letters and digits if it has letters."""
    return re.sub(r"[^A-Za-z0-9]", "", found).lower()


def _good_candidates(scanned: DataFrame, scratch: Scratch, confidence: float, support: int) -> DataFrame:
    """(ctx, value, kind) of candidates that patterns of high confidence surround."""
    finds = lambda column, kind: scanned.select(F.explode(column).alias("c")).select(kind.alias("kind"), F.explode("c.ctx").alias("ctx"), "c.value").distinct()
    # Distinct instances of a pattern, whatever the number of their copies; kind is null for candidates.
    seeds = scratch.write(finds("__t_seeds", F.col("c.kind")), "seeds")
    loose = scratch.write(finds("__t_loose", F.lit(None).cast("string")), "candidates")
    sure = seeds.select("kind", "value").distinct()
    none = seeds.select("ctx", "value", "kind").limit(0)
    good, n_good = none, 0
    for _ in range(INDUCTIONS):
        own = seeds.join(sure, ["kind", "value"], "left_semi").unionByName(loose.drop("kind").join(sure, "value").select("kind", "ctx", "value"))
        patterns = own.distinct().groupBy("kind", "ctx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select(F.col("kind").alias("of"), "ctx")
        met = loose.join(patterns, "ctx").select(F.col("of").alias("kind"), "ctx", "value", F.lit(None).cast("double").alias("fixed"))
        if met.isEmpty():
            return good
        fixed = seeds.join(patterns, "ctx").select(F.col("of").alias("kind"), "ctx", "value", (F.col("kind") == F.col("of")).cast("double").alias("fixed"))
        edges = fixed.unionByName(met).groupBy("kind", "ctx", "value").agg(F.max("fixed").alias("fixed"))
        edges = scratch.write(edges, "edges")
        instances = scratch.write(edges.groupBy("kind", "value").agg(F.max("fixed").alias("fixed")).withColumn("score", F.coalesce("fixed", F.lit(0.0))), "instances")
        for _ in range(ROUNDS):
            by_pattern = edges.join(instances.select("kind", "value", "score"), ["kind", "value"]).groupBy("kind", "ctx").agg((F.sum("score") / (F.count(F.lit(1)) + 0.5)).alias("p"))
            after = edges.where("fixed IS NULL").join(by_pattern, ["kind", "ctx"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p")))))).alias("_new"))
            after = scratch.write(instances.join(after, ["kind", "value"], "left").select("kind", "value", "fixed", F.coalesce("fixed", "_new").alias("score"), F.abs(F.coalesce("fixed", "_new") - F.col("score")).alias("moved")), "instances")
            scratch.drop(instances)
            instances = after.drop("moved")
            instances._scratch_path = after._scratch_path
            if after.agg(F.max("moved")).first()[0] < TOLERANCE:
                break
        # A value's kind is the one it scores highest for; candidates of a confident value count where a pattern surrounds them.
        best = instances.where(F.col("score") >= confidence).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        good = scratch.write(edges.where("fixed IS NULL").join(best, ["value", "kind"]).select("ctx", "value", "kind"), "good")
        before, n_good = n_good, good.select("value").distinct().count()
        if n_good == before:
            break
        sure = seeds.select("kind", "value").unionByName(good.select("kind", "value")).distinct()
    return good


def personal_data_digest(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, a count of each kind's base spans, base_sha256, spans and n_added.

    A row for each row: null texts count as empty and have no spans, repeated
    rows are judged alike; an empty table gives an empty result.
    """
    found = find_personal_data(docs.select(row_id, text), text)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["a"].alias("a"), order[s["kind"]].alias("k"), s["b"].alias("b"), s["kind"].alias("kind")))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == F.lit(k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(row_id, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(keyed)).alias("spans"), F.size("added").cast("long").alias("n_added"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

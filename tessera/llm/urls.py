"""URL filters: a trie over reversed host labels and then path segments.

The trie is broadcast and walked for each url; the deepest rule met, allow or
block, decides.  Beyond a checked number of rules, urls and rules are joined
on each host suffix and path prefix instead, which gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import extended, once

#: Rules that a broadcast trie may hold: about 400 bytes each.
TRIE_RULES = 200_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Rule(NamedTuple):
    """``host`` in lower case, ``path`` from its slash on; allows or blocks."""

    host: str
    path: str
    verdict: str


def parse(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Trie:
    """Nodes are dicts; "" keys hold the path trie of a host, whose None keys hold rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("host", label), {})
            node = node.setdefault("paths", {})
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            # Of two rules for the same place, block wins.
            tails = node.setdefault("tails", {})
            if tail not in tails or rule.verdict == "block":
                tails[tail] = rule
            if len(tail) not in node.setdefault("lengths", []):
                node["lengths"] = sorted([*node["lengths"], len(tail)], reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule with the longest host and then the longest path that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> Rule | None:
        best, at = None, 0
        while node is not None:
            tails = node.get("tails", {})
            # As many look-ups as there are lengths of tails here, however many tails.
            for n in node.get("lengths", ()):
                if rule := tails.get(path[at : at + n]):
                    best = rule
                    break
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.get(("segment", path[at:end])), end + 1
        return best


_NEW = ["host", "path", "rule", "verdict"]


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """Every row of ``df`` with host, path, rule and verdict of its url.

    ``rules`` is a list or a table (host, path, verdict).  A rule fits its host
    and all subdomains if the url's path starts with the rule's path; the rule
    with the longest host, then the longest path, wins, and block wins a tie.
    A null or empty url, and one without ://, has empty host and path, no rule
    and the default verdict.  Other columns are carried along, those named as
    the new ones are replaced; an empty table gives an empty result.
    """
    spark = df.sparkSession
    df = df.drop(*_NEW)
    table = isinstance(rules, DataFrame)
    if table:
        found = rules.select("host", "path", "verdict").limit(trie_rules + 1).collect()
        few = [Rule(r[0] or "", r[1] or "", r[2]) for r in found]
    else:
        few = rules
    if len(few) <= trie_rules:
        return _by_trie(df, few, url, default)
    every = rules if table else spark.createDataFrame(rules, "host string, path string, verdict string")
    return _by_join(df, every, url, default)


def _by_trie(df: DataFrame, rules: list[Rule], url: str, default: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rules)
    schema = extended(df.schema, ", ".join(f"{n} string" for n in _NEW))
    at = df.columns.index(url)

    def judge(batches):
        trie = once(shared.value, "trie", Trie)
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for u in batch.column(at).to_pylist():
                host, path = parse(u)
                rule = trie.find(host, path)
                hosts.append(host)
                paths.append(path)
                names.append(rule.host + rule.path if rule else None)
                verdicts.append(rule.verdict if rule else default)
            own = [pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *_NEW])

    return df.mapInArrow(judge, schema)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _by_join(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The same for rules without a bound: distinct urls meet the rules by host suffix, and prefixes are compared."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")).groupBy("_h", "_p").agg(F.max("_v").alias("_v"))
    urls = df.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # A rule's path is cut at its last slash; a url meets it by its own prefix at that slash.
    rules = rules.withColumn("_dir", F.regexp_extract("_p", r"^(.*/)", 1))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    met = (
        urls.withColumn("_h", F.explode(suffixes))
        .withColumn("_dir", F.explode(prefixes))
        .join(rules, ["_h", "_dir"])
        .where(F.col("path").startswith(F.col("_p")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("_h"), F.length("_p"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))).alias("_best"))
        .select("host", "path", "_best.rule", "_best.verdict")
    )
    out = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).join(met, ["host", "path"], "left")
    return out.select(*df.columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

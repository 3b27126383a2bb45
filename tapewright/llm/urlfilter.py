"""URL filters as a sort-merge range join.

A rule names a host and a path prefix.  The canonical key of a host is its
labels reversed, each followed by a dot (``blog.example.net`` ->
``net.example.blog.``), so a rule's host and all its subdomains form the one
interval of keys that start with the rule's key.  Urls are sorted by key within
their partitions (Spark's external sort, no shuffle) and swept beside the sorted
rules; a stack holds the rules whose interval the sweep is inside, nested from
the widest to the narrowest, and the url's path decides among those.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

#: A pass sweeps beside at most so many rules; longer lists take more passes.
BLOCK_RULES = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """``["block net/", "allow example.net/en/"]`` as rules."""
    out = []
    for line in lines:
        verdict, _, rule = line.partition(" ")
        if verdict not in ("allow", "block") or not rule:
            raise ValueError(f"not a rule: {line!r}")
        host, slash, path = rule.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return out


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where ``://`` is missing."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(u, locate('://', u) + 3)"))
    head = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    tail = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return ascii_lower(F.coalesce(head, F.lit(""))), F.coalesce(tail, F.lit(""))


def precedence(r: Rule) -> tuple[int, int, bool]:
    """Greater wins: the longer rule, of equal lengths the longer host, of equal rules ``allow``."""
    return len(r.text), len(r.host), r.verdict == "allow"


class Paths:
    """The path prefixes of one host's rules, as nested intervals of sorted strings."""

    def __init__(self, rules: list[Rule]):
        best: dict[str, Rule] = {}
        for r in rules:
            if r.path not in best or precedence(r) > precedence(best[r.path]):
                best[r.path] = r
        self.paths = sorted(best)
        self.rules = [best[p] for p in self.paths]
        # for each path, the longest other path that it starts with: a stack over the sorted list
        self.outer, stack = [], []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> Rule | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """Judges urls that come in ascending order of host key."""

    def __init__(self, rules: list[Rule]):
        by_key: dict[str, list[Rule]] = {}
        for r in rules:
            by_key.setdefault(host_key(r.host), []).append(r)
        self.keys = sorted(by_key)
        self.rules = [Paths(by_key[k]) for k in self.keys]
        self.at, self.active = 0, []

    def judge(self, key: str, path: str) -> Rule | None:
        active = self.active
        while active and not key.startswith(active[-1][0]):
            active.pop()
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            if key.startswith(self.keys[self.at]):
                active.append((self.keys[self.at], self.rules[self.at]))
            self.at += 1
        found = [r for _, rules in active if (r := rules.longest(path)) is not None]
        return max(found, key=precedence, default=None)


def judge_urls(pages: DataFrame, rules: list[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest rule (host and path together; of equal lengths the longer host)
    wins; of equal rules with different verdicts ``allow`` wins.  Where no rule
    fits, ``rule`` is null and ``verdict`` is ``default``.  A null url or one
    without ``://`` has an empty host and path.  Null ids stay null, repeated
    rows give repeated results, an empty table or rule list is fine, and other
    columns are not read.

    Rules go to the tasks in blocks of at most ``BLOCK_RULES``; each block is a
    sweep over the sorted urls and the answer that wins by the same order stays, so
    results don't depend on the blocks.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = split_url(F.col("u"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    out = urls.withColumn("k", key).sortWithinPartitions("k").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "won": F.lit(None).cast("array<int>")})
    names = ["page_id", "host", "path", "k", "rule", "verdict", "won"]
    ordered = sorted(set(rules), key=lambda r: (host_key(r.host), r.path, r.verdict))
    for at in range(0, len(ordered), BLOCK_RULES):
        block = spark.sparkContext.broadcast([tuple(r) for r in ordered[at : at + BLOCK_RULES]])

        def run(batches, block=block):
            sweep = Sweep([Rule(*r) for r in block.value])
            for b in batches:
                rule, verdict, won = (b.column(i).to_pylist() for i in (4, 5, 6))
                for i, (k, p) in enumerate(zip(b.column(3).to_pylist(), b.column(2).to_pylist())):
                    r = sweep.judge(k, p)
                    if r is not None and (won[i] is None or list(precedence(r)) > won[i]):
                        rule[i], verdict[i], won[i] = r.text, r.verdict, list(map(int, precedence(r)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(won, pa.list_(pa.int32()))], names)

        out = out.mapInArrow(run, f"page_id {kind}, host string, path string, k string, rule string, verdict string, won array<int>")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

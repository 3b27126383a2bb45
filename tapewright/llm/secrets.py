"""Secret scans through a trigram index (DataFrame functions only).

Each rule's regex is turned, on the driver, into a Boolean query over trigrams
that any match must contain.  The inverted index lists, for each of the trigrams
that some rule asks for, the documents that hold it; it is a written table.  The
lists are intersected and united as the queries say, which gives the candidates of
each rule.  Only candidates are verified with the rule's regex; a rule without
mandatory trigrams verifies every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, written

#: At most so many strings are told apart while a query is derived.
EXACT_STRINGS = 48
MARK = "[SECRET]"
#: Candidates (a key and a few flags each) are broadcast up to so many, else joined by shuffle.
BROADCAST_CANDIDATES = 500_000
#: Items of a running total that are listed at once.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``regex``: for Java; ``group`` must have at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The base kinds, in their listed order, and then what this method adds.
BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 and more: the same matches as [0-9a-f]+ without those that fail
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + ADDED


# --- Boolean trigram queries -------------------------------------------------
# A query is True (anything may match), a trigram, or ("and" | "or", parts).


def _join(op: str, parts: list):
    flat = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    flat = list(dict.fromkeys(flat))
    if op == "or":  # a conjunction that asks for more than another one adds nothing
        asks = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" and all(isinstance(q, str) for q in p[1]) else frozenset([p]) for p in flat}
        flat = [p for p in flat if not any(asks[o] < asks[p] for o in flat)]
    return True if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _of_strings(strings: set[str]):
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def _walk(items):
    """(all strings the items can match, True), or (None, their query) if those are too many."""
    k = re._constants
    exact, parts, open_ended = {""}, [], False
    for op, arg in items:
        one, query = None, True
        if op is k.LITERAL:
            one = {chr(arg).lower()}
        elif op is k.IN:
            one = _characters(arg)
        elif op is k.SUBPATTERN:
            one, query = _walk(arg[-1])
        elif op is k.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(e is not None for e, _ in branches):
                one = set().union(*(e for e, _ in branches))
            else:
                query = _join("or", [q if e is None else _of_strings(e) for e, q in branches])
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            low, high, body = arg
            strings, inner = _walk(body)
            if strings is not None and low == 0 and high == 1:
                one = strings | {""}
            elif strings is not None and low == high and len(strings) == 1 and low <= 64:
                one = {next(iter(strings)) * low}
            elif low >= 1:
                query = inner if strings is None else _of_strings(strings)
        elif op is k.AT:
            one = {""}
        if one is not None and len(one) * len(exact) <= EXACT_STRINGS:
            exact = {a + b for a, b in product(exact, one)}
        else:
            open_ended = True
            parts += [_of_strings(exact), query]
            exact = {""} if one is None else one
    return (None, _join("and", [*parts, _of_strings(exact)])) if open_ended else (exact, True)


def _characters(items) -> set[str] | None:
    """The lower-cased members of a small character class."""
    out: set[str] = set()
    for kind, x in items:
        if kind is re._constants.LITERAL:
            out.add(chr(x).lower())
        elif kind is re._constants.RANGE and x[1] - x[0] < 12:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 12 else None


def trigram_query(regex: str):
    """The Boolean trigram query of a regex, over lower-cased text."""
    exact, query = _walk(list(re._parser.parse(regex)))
    return query if exact is None else _of_strings(exact)


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# --- the index ---------------------------------------------------------------


class TrigramIndex:
    """Inverted lists of the trigrams that ``rules`` ask for."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = tuple(rules)
        self.queries = {r.kind: trigram_query(r.regex) for r in rules}
        self.terms = sorted(set().union(*map(trigrams, self.queries.values()))) if rules else []
        self.at = {t: divmod(i, 62) for i, t in enumerate(self.terms)}
        self.words = -(-len(self.terms) // 62)

    def postings(self, docs: DataFrame, key: Column, text: Column) -> DataFrame:
        """Rows ``trigram, doc`` of the terms in each lower-cased text, sorted by trigram within a task."""
        src = docs.select(key.alias("doc"), F.lower(text).alias("low"))
        own = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in self.terms]).cast("array<string>"))
        return src.select(F.explode(own).alias("trigram"), "doc").sortWithinPartitions("trigram")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """Intersects and unites the lists: ``doc`` and, per rule with mandatory trigrams, whether its query holds.

        A document's entries of all lists meet as bits, combined before they are shuffled.
        """
        def bit(w: int) -> Column:
            own = F.create_map(*[F.lit(x) for t, (v, i) in self.at.items() if v == w for x in (t, 1 << i)])
            return F.coalesce(F.element_at(own, F.col("trigram")), F.lit(0)).cast("long")

        met = postings.groupBy("doc").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in range(self.words)])
        bits = [F.col(f"w{w}") for w in range(self.words)]
        asked = [r.kind for r in self.rules if self.queries[r.kind] is not True]
        found = met.select("doc", *[self.matches(self.queries[k], bits).alias(k) for k in asked])
        return found.where(reduce(or_, [F.col(k) for k in asked]))

    def matches(self, query, bits: list[Column]) -> Column:
        if isinstance(query, str):
            query = ("and", (query,))
        if query[0] == "and" and all(isinstance(q, str) for q in query[1]):
            masks: dict[int, int] = {}
            for t in query[1]:
                w, i = self.at[t]
                masks[w] = masks.get(w, 0) | 1 << i
            return reduce(and_, [bits[w].bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()])
        return reduce(and_ if query[0] == "and" else or_, [self.matches(q, bits) for q in query[1]])


# --- verification ------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with a ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(x: str, merge: str) -> str:
    """SQL: running totals of an array of ints, each with its own item; ``merge``: the total of ``a`` and ``b``.

    In blocks: no step copies more than one block or one item of every block.
    """

    def totals(start: str, items: str) -> str:
        step = merge.format(a="acc.now", b="item")
        return f"aggregate({items}, named_struct('now', {start}, 'all', cast(array() AS array<int>)), (acc, item) -> named_struct('now', {step}, 'all', concat(acc.all, array({step}))), acc -> acc.all)"

    blocks = f"transform(sequence(1, greatest(1, size(run)), {BLOCK}), at -> slice(run, at, {BLOCK}))"
    block_ends = totals("0", f"transform(blocks, block -> aggregate(block, 0, (sofar, item) -> {merge.format(a='sofar', b='item')}))")
    starts = _let("block_ends", block_ends, "concat(array(0), slice(block_ends, 1, size(block_ends) - 1))")
    joined = f"flatten(zip_with(blocks, {starts}, (block, start) -> {totals('start', 'block')}))"
    return _let("run", x, _let("blocks", blocks, joined))


SPANS = "array<struct<start:int,no:int,kind:string,end:int,from:int,to:int>>"


def _spans(rule: Rule, number: int, text: str, candidate: str) -> Column:
    """Spans of one rule: array of (start, no, kind, end, from, to), ends exclusive; from and to are bytes.

    The pieces between the matches give the positions: ``split`` and
    ``regexp_extract_all`` see the same leftmost, non-overlapping matches.  ``text``
    and ``candidate`` are SQL.
    """
    rx = "'" + rule.regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sizes = f"zip_with(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0), (p, m) -> named_struct('gap', length(p), 'len', length(m), 'gap_b', octet_length(p), 'len_b', octet_length(m)))"
    # the piece behind the last match has none
    sizes = f"filter({sizes}, x -> x.len IS NOT NULL)"
    own = f"transform(regexp_extract_all({text}, {rx}, {rule.group}), g -> length(g))"
    ends = _running("transform(found, x -> x.gap + x.len)", "{a} + {b}")
    to = _running("transform(found, x -> x.gap_b + x.len_b)", "{a} + {b}")
    placed = f"zip_with(zip_with(found, {ends}, (x, e) -> named_struct('x', x, 'e', e)), zip_with({to}, {own}, (t, g) -> named_struct('t', t, 'g', g)), (l, r) -> named_struct('start', l.e - l.x.len, 'end', l.e, 'from', r.t - l.x.len_b, 'to', r.t, 'own', r.g))"
    kept = f"transform(filter({placed}, s -> s.own >= {rule.least}), s -> named_struct('start', s.start, 'no', {number}, 'kind', '{rule.kind}', 'end', s.end, 'from', s.from, 'to', s.to))"
    return F.expr(f"CASE WHEN {candidate} AND {text} RLIKE {rx} THEN cast({_let('found', sizes, kept)} AS {SPANS}) ELSE cast(array() AS {SPANS}) END")


def _found(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, id_col: str, out: str) -> DataFrame:
    """``docs`` with the column ``out`` of spans; see ``find_secrets``."""
    index = TrigramIndex(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    asked = [r.kind for r in index.rules if index.queries[r.kind] is not True]
    names = {k: fresh(f"fits_{k}", docs.columns, [out]) for k in asked}
    joined = docs
    if asked:
        # rows of equal id and text share an entry; a key that two texts have by chance only verifies one text more
        key = F.xxhash64(*[c for c in (id_col, text_col) if c in docs.columns])
        own = fresh("doc", docs.columns, [out], names.values())
        postings = written(index.postings(docs, key, text))
        fits = written(index.candidates(postings)).select(F.col("doc").alias(own), *[F.col(k).alias(n) for k, n in names.items()])
        few = fits.count() <= BROADCAST_CANDIDATES
        joined = docs.withColumn(own, key).join(F.broadcast(fits) if few else fits.hint("merge"), own, "left").drop(own)
    whole = f"coalesce(`{text_col}`, '')"
    parts = [_spans(r, i, whole, f"coalesce(`{names[r.kind]}`, false)" if r.kind in names else "true") for i, r in enumerate(index.rules)]
    return joined.withColumn(out, F.array_sort(F.concat(*parts))).drop(*names.values())


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", id_col: str = "doc_id", spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with an array column of (start, no, kind, end) of every rule's matches.

    Positions are code points from 0, ends exclusive, sorted by start and then
    by the rules' order; matches of one rule don't overlap, those of different
    rules may.  A null or empty text has no spans.  Null ids and repeated rows are
    fine; rows and other columns stay as they are, an empty table gives an empty
    result; a column that is already named ``spans_col`` is replaced.

    The index (rows trigram, document) is written first; its lists are intersected
    to the candidates of each rule, which the documents are joined with: by
    broadcast up to ``BROADCAST_CANDIDATES`` candidates, else by shuffle.
    No row leaves the JVM.
    """
    found = _found(docs, rules, text_col, id_col, spans_col)
    return found.withColumn(spans_col, F.expr(f"transform(`{spans_col}`, s -> named_struct('start', s.start, 'no', s.no, 'kind', s.kind, 'end', s.end))"))


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` comma-joined, of all spans or those of ``kinds``."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[SECRET]``.

    Overlapping spans become one mark; texts without a secret, null ones
    included, stay as they are.  Repeated rows and null ids are redacted alike.
    Keeps the columns of ``docs``.
    """
    out = fresh("spans", docs.columns)
    found = _found(docs, rules, text_col, id_col, out)
    reached = _running(f"transform(`{out}`, s -> s.to)", "greatest({a}, {b})")
    gaps = f"filter(zip_with(`{out}`, concat(array(0), slice(reached, 1, size(reached) - 1)), (s, at) -> named_struct('at', at, 'to', s.from)), g -> g.to >= g.at)"
    pieces = f"transform({gaps}, g -> cast(substring(raw, g.at + 1, g.to - g.at) AS string))"
    rest = "cast(substring(raw, element_at(reached, -1) + 1, octet_length(raw)) AS string)"
    clean = _let("raw", f"cast(`{text_col}` AS binary)", _let("reached", reached, f"array_join(concat({pieces}, array({rest})), '{MARK}')"))
    return found.withColumn(text_col, F.expr(f"CASE WHEN size(`{out}`) > 0 THEN {clean} ELSE `{text_col}` END")).select(*docs.columns)

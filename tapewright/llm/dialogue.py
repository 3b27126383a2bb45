"""Repair of conversations' structure, by signatures that are solved once.

A row counts for the repair only by its role's initial and its first fault, so a
conversation is a string of one letter a row.  Such signatures repeat: each
distinct one is solved once, by a memoised recursion over its tails, and the
edits are joined back and replayed over the texts.

A conversation may be of any length.  Rows are ordered by range partitioning (a
huge conversation spreads over tasks) and cut into blocks of at most ``BLOCK``
letters.  What a block needs to know of all later ones is four numbers, the costs
of the best repair of the rest from each state of the role grammar; they are
chained from a conversation's last block backwards over the short blocks alone.
Only then are texts shuffled, once: they meet their blocks' edits in sorted order
and stream through a running digest in constant memory.  The digest of one
conversation's repaired text is sequential by definition, so those texts pass
through one task.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import union, written

#: Letters of a block: role initial (s, u, a, any other) by fault (none, truncated, blank, duplicate).
BLOCK, LETTERS = 256, "suaxSUAX12345678"
BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.  Where user or assistant lead, whichever is legal.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
DELETE, CHANGE = 4, 3
#: Costs of an accepted end from each state, by inserts alone.
END = (0, 2 * CHANGE, CHANGE, 0)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .drop("copy")
    )


@lru_cache(maxsize=100_000)
def costs(tail: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost of repairing ``tail`` from each state, given the costs ``after`` it."""
    if not tail:
        return after
    rest = costs(tail[1:], after)
    row = [min(c for c, _, _ in _edits(tail[0], q, rest)) for q in range(4)]
    u, a = min(row[2], CHANGE + row[3]), min(row[3], CHANGE + row[2])
    return min(row[0], CHANGE + u), min(row[1], CHANGE + u), u, a


def _edits(letter: str, q: int, rest: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """What may happen to a row in state ``q``: whole cost, edit, next state."""
    fault, initial = divmod(LETTERS.index(letter), 4)
    out = [(DELETE + rest[q], "D", q)]
    if fault < 2:
        own, keep = fault * CHANGE, KEEP["suax"[initial]][q]
        out += [(own + rest[keep], "K", keep)] if keep is not None else []
        out.append((own + CHANGE + rest[NEXT[q]], "R", NEXT[q]))
    return out


def walk(signature: str, after: tuple[int, ...], last: bool, q: int) -> tuple[int, int, str]:
    """From state ``q`` along the cheapest edits, of equal ones the ASCII-least: the state behind, own cost, edits.

    An edit determines the next state, so the least letter at each step is the least string.
    """
    edits, first = [], costs(signature, after)[q]
    for at, letter in enumerate(signature):
        here, rest = costs(signature[at:], after), costs(signature[at + 1 :], after)
        while True:
            options = [*_edits(letter, q, rest), (CHANGE + here[NEXT[q]], "I", NEXT[q])]
            _, edit, q = min(o for o in options if o[0] == here[q])
            edits.append(edit)
            if edit != "I":
                break
    cost = first - after[q]
    while last and END[q]:
        edits.append("I")
        cost, q = cost + CHANGE, NEXT[q]
    return q, cost, "".join(edits)


def illegal(initials: str) -> int:
    """Neighbouring initials other than su, ua and au."""
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def _initials(signature: str) -> str:
    return "".join("suax"[LETTERS.index(c) % 4] for c in signature)


_SOLVED = "signature string, after string, last boolean, ends array<int>, costs array<long>, edits array<string>, blank long, duplicate long, truncated long, illegal long, initials string"


def _solve(batches):
    for b in batches:
        out = []
        for signature, after, last in zip(*(b.column(i).to_pylist() for i in range(3))):
            ways = [walk(signature, tuple(map(int, after.split(","))), last, q) for q in range(4)]
            faults, names = [sum(LETTERS.index(c) // 4 == k for c in signature) for k in range(4)], _initials(signature)
            out.append((signature, after, last, *map(list, zip(*ways)), faults[2], faults[3], faults[1], illegal(names), names[0] + names[-1]))
        yield _batch(out, [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string()], [f.split()[0] for f in _SOLVED.split(", ")])


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _blocks(batches):
    """Rows in order -> blocks: the conversation, the place, the first row's turn and key, the letters."""
    part, no, kinds = TaskContext.get().partitionId(), 0, None
    open_: list | None = None  # conversation, turn, key, letters
    for b in batches:
        kinds, done = [b.schema.field(i).type for i in range(3)], []
        for conv, turn, key, letter in zip(*(b.column(i).to_pylist() for i in range(4))):
            if open_ is None or open_[0] != conv or len(open_[3]) == BLOCK:
                done += [open_] if open_ else []
                open_ = [conv, turn, key, []]
            open_[3].append(letter)
        yield _block_batch(done, part, no, kinds)
        no += len(done)
    if open_:
        yield _block_batch([open_], part, no, kinds)


_BLOCK = ["conv_id", "turn", "key", "signature", "part", "no"]


def _block_batch(done: list, part: int, no: int, kinds: list) -> pa.RecordBatch:
    return _batch([(c, t, k, "".join(s), part, no + i) for i, (c, t, k, s) in enumerate(done)], [*kinds, pa.string(), pa.int32(), pa.int64()], _BLOCK)


def _chain(batches):
    """Blocks of a conversation, last first -> the same with the costs after each and whether it is the last."""
    conv, after, later = None, END, None  # later: the block behind, not yet folded into ``after``
    for b in batches:
        afters, lasts = [], []
        for c, signature in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            if later is None or c != conv:
                conv, after, later = c, END, None
            else:
                after = costs(later, after)
                after = tuple(x - min(after) for x in after)
            afters.append(",".join(map(str, after)))
            lasts.append(later is None)
            later = signature
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(afters, pa.string()), pa.array(lasts, pa.bool_())], [*_BLOCK, "after", "last"])


class _Open:
    """A conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv, self.gaps, self.counts, self.cost = conv, 0, [0, 0, 0, 0], 0
        self.state, self.last, self.waiting, self.audit = 0, "", deque(), []
        self.at, self.role, self.said, self.sha = 0, 0, False, hashlib.sha256()

    def block(self, ends, costs_, edits, counts, initials):
        q = self.state
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += illegal(self.last + initials[0]) if self.last else 0
        self.last, self.state, self.cost = initials[1], ends[q], self.cost + costs_[q]
        self.waiting.append(edits[q])
        self.audit.append(edits[q])

    def _edit(self) -> str | None:
        while self.waiting and self.at == len(self.waiting[0]):
            self.waiting.popleft()
            self.at = 0
        if not self.waiting:
            return None
        self.at += 1
        return self.waiting[0][self.at - 1]

    def _say(self, role: bytes, text: bytes):
        if self.said:
            self.sha.update(b"\n")
        self.said = True
        self.sha.update(role + b":")
        self.sha.update(text)

    def _insert(self, text: bytes = b""):
        self.role = NEXT[self.role]
        self._say(b"user" if self.role == 2 else b"assistant", text)

    def row(self, role: bytes, text: bytes):
        while (edit := self._edit()) == "I":
            self._insert()
        if edit == "R":
            self._insert(text)
        elif edit == "K":
            self.role = KEEP[chr(role[0])][self.role]
            self._say(role, text)
        elif edit != "D":
            raise ValueError("a row without its edit")

    def result(self) -> tuple:
        while self._edit() == "I":
            self._insert()
        blank, duplicate, truncated, breaks = self.counts
        return self.conv, self.gaps, blank, duplicate, truncated, breaks, self.cost, "".join(self.audit), self.sha.hexdigest()


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_STREAM = ["conv_id", "kind", "role", "text", "gaps", "ends", "costs", "edits", "blank", "duplicate", "truncated", "illegal", "initials"]


def _replay(batches):
    """Per conversation its gaps, then blocks and rows in order -> one row of results."""
    now, kind = None, None
    for b in batches:
        kind, done = b.schema.field(0).type, []
        for conv, what, role, text, gaps, ends, costs_, edits, *counts, initials in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now.conv != conv:
                done += [now.result()] if now else []
                now = _Open(conv)
            if what == 0:
                now.gaps = max(now.gaps, gaps)
            elif what == 1:
                now.block(ends, costs_, edits, counts, initials)
            else:
                now.row(role, text)
        yield _result_batch(done, kind)
    if now:
        yield _result_batch([now.result()], kind)


def _result_batch(done: list, kind) -> pa.RecordBatch:
    return _batch(done, [kind, *[pa.int64()] * 6, pa.string(), pa.string()], _RESULT)


def _letter(role: Column, blank: Column, duplicate: Column, truncated: Column) -> Column:
    fault = F.when(blank, 2).when(duplicate, 3).when(truncated, 1).otherwise(0)
    initial = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(4)
    return F.substring(F.lit(LETTERS), initial + 4 * fault, F.lit(1))


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text``), and per further ``conv_id`` of ``ids``: faults, the cheapest repair and its digest.

    Rows are taken by turn (nulls first); rows of one turn by the SHA-256 of role and
    text.  A null role or text is one space.  Rows with a null ``conv_id`` are one
    conversation.  A repeated row is a duplicate.  A conversation without rows has
    zeros, an empty audit and the digest of nothing; empty tables give an empty
    result.  Other columns of both tables, whatever their names, are not read.
    """
    kind = rows.schema["conv_id"].dataType
    full = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    full = full.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    short = written(full.select("conv_id", "turn", "key", F.substring("role", 1, 1).alias("role"), (end == "").alias("is_blank"), (~end.isin(".", "!", "?")).alias("is_truncated"), F.monotonically_increasing_id().alias("copy")))

    first = short.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("turn", "copy")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "copy"))
    marked = short.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    lettered = marked.select("conv_id", "turn", "key", _letter(F.col("role"), F.col("is_blank"), seen, F.col("is_truncated")).alias("letter"), "copy")
    order = ["conv_id", "turn", "key", "copy"]
    turn = rows.schema["turn"].dataType
    block = T.StructType([T.StructField("conv_id", kind), T.StructField("turn", turn), T.StructField("key", T.BinaryType()), T.StructField("signature", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())])
    blocks = written(lettered.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy").mapInArrow(_blocks, block))

    chained = T.StructType([*block.fields, T.StructField("after", T.StringType()), T.StructField("last", T.BooleanType())])
    chain = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no")).mapInArrow(_chain, chained)
    chain = written(chain)
    question = ["signature", "after", "last"]
    solved = chain.select(question).distinct().mapInArrow(_solve, _SOLVED)
    markers = chain.join(solved, question)

    turns = short.groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    gaps = turns.select("conv_id", F.coalesce((F.col("hi") - F.col("lo") + 1 - F.col("n")).cast("long"), F.lit(0).cast("long")).alias("gaps"))
    if ids is not None:
        gaps = gaps.unionByName(ids.select("conv_id").distinct().withColumn("gaps", F.lit(0).cast("long")))
    wide = T.StructType([T.StructField("conv_id", kind), T.StructField("turn", turn), T.StructField("key", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType()), T.StructField("role", T.BinaryType()), T.StructField("text", T.BinaryType()), T.StructField("gaps", T.LongType()), *T.StructType.fromDDL(_SOLVED).fields[3:]])
    padded = lambda df, k: df.select(F.lit(k).alias("kind"), *[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wide])
    stream = union([padded(gaps, 0), padded(markers, 1), padded(full, 2)]).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "key", "kind", "part", "no")
    result = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in _RESULT[1:7]], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return stream.select(*_STREAM).mapInArrow(_replay, result)

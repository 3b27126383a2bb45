import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from support import SMALL
from tapewright.llm import dialogue as d
from tapewright.llm.queries import QUERIES

ROW = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def best(rows):
    """Least (cost, edits) of a list of (initial, fault), by plain recursion on what is left and the roles so far."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserts):
        options = [(0, "")] if i == len(rows) and state in ("", "a") else []
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for c in legal:
            if c != "s" and inserts < 3:
                n = rest(i, c, inserts + 1)
                options.append((n[0] + 3, "I" + n[1]))
        if i < len(rows):
            initial, fault = rows[i]
            n = rest(i + 1, state, 0)
            options.append((n[0] + 4, "D" + n[1]))
            if fault not in ("blank", "duplicate"):
                own = 3 if fault == "truncated" else 0
                if initial and initial in legal:
                    n = rest(i + 1, initial, 0)
                    options.append((n[0] + own, "K" + n[1]))
                for c in legal.replace("s", ""):
                    n = rest(i + 1, c, 0)
                    options.append((n[0] + own + 3, "R" + n[1]))
        return min(options, default=(10**9, ""))

    for i in reversed(range(len(rows) + 1)):  # from the end, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            rest(i, state, 0)
    return rest(0, "", 0)


def brute(rows, ids):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r[1:])
    out = []
    for conv in {*groups, *ids}:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, key(r[1], r[2])))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in own]
        cost, audit = best(tuple(zip(initials, faults)))
        said, role, i = [], "", 0
        for edit in audit:
            want = {"": "user", "u": "assistant"}.get(role[:1], "user")
            if edit == "D":
                i += 1
                continue
            role = own[i][1] if edit == "K" else want
            said.append(f"{role}:{'' if edit == 'I' else own[i][2]}")
            i += edit != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, ids=None, partitions=3):
    df = spark.createDataFrame(rows, ROW).repartition(partitions).selectExpr("*", "'x' AS key", "1 AS kind", "2 AS signature", "3 AS cost", "4 AS first")
    got = d.repair(df, None if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long"))
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def invented(seed, n, rows=(0, 12)):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(r.randint(*rows)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Usher", "usher"])
            text = r.choice(["Yes.", "No!", "Why?", "so", "x. \n", "\t ", "", "é…", "x" * 3 + "!"]) + r.choice(["", "", f" {r.randrange(9)}.", " ok"])
            out.append((conv if r.random() < 0.97 else None, turn * r.choice([1, 1, 2]) if r.random() < 0.95 else None, role, text))
    return out


def test_damage_equals_a_loop(spark):
    rows = invented(1, 60) + [(1, None, None, None), (None, None, "user", "a."), (2, 3, None, "a!?."), (5, 1, "user", None)]
    got = d.damage(spark.createDataFrame(rows, ROW).repartition(3).selectExpr("*", "7 AS kind", "8 AS copy"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(damaged(rows), key=repr)


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    rows = damaged(invented(2, 80))
    assert run(spark, rows, range(-2, 80)) == brute(rows, range(-2, 80))


def test_odd_rows(spark):
    rows = [(None, None, "user", "a."), (None, None, "user", "a."), (1, None, " ", " "), (2, 5, "assistant", "b" * 200_000 + "."), (3, 1, "user", "c."), (3, 1, "user", "c."), (3, 1, "user", "d."), (4, 9, "", "")]
    assert run(spark, rows) == brute(rows, [])
    assert run(spark, [], [7, 7, None]) == brute([], [7, None]) and run(spark, []) == []


def test_one_huge_conversation(spark):
    """3,000 rows of one conversation, a third of them equal, spread over blocks and tasks."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), f"text {t}{r.choice('.. ')}") for t in range(2_000)] + [(1, 700, "user", "again.")] * 1_000 + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
    got = run(spark, rows, partitions=4)
    conv = brute(rows, [])
    assert got == conv


def test_blocks_are_bounded_and_spread(spark, monkeypatch):
    seen = []
    whole = d.written
    monkeypatch.setattr(d, "written", lambda df, **o: seen.append(whole(df, **o)) or seen[-1])
    rows = [(1, t, "user", f"text {t}.") for t in range(20_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes go to one task
    try:
        run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = seen[1].selectExpr("part", "length(signature) AS n").collect()
    assert max(b["n"] for b in blocks) <= d.BLOCK and len({b["part"] for b in blocks}) > 1 and sum(b["n"] for b in blocks) == 20_000


def test_edits_are_the_cheapest_and_least_of_all():
    """Every string of edits up to a length, for all short signatures."""
    faults = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}

    def tried(rows):
        found = []
        for n in range(len(rows) + 4):
            for edits in itertools.product("DIKR", repeat=n):
                i, state, cost = 0, "", 0
                for e in edits:
                    if e != "I":
                        if i == len(rows):
                            break
                        initial, fault = rows[i]
                        i += 1
                        if e == "D":
                            cost += 4
                            continue
                        if fault in ("blank", "duplicate"):
                            break
                        cost += 3 * (fault == "truncated")
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    nxt = initial if e == "K" else legal[-1]
                    if nxt not in legal:
                        break
                    state, cost = nxt, cost + (0 if e == "K" else 3)
                else:
                    if i == len(rows) and state in ("", "a"):
                        found.append((cost, "".join(edits)))
        return min(found)

    for n in range(3):
        for signature in map("".join, itertools.product(d.LETTERS, repeat=n)):
            rows = tuple(("suax"[d.LETTERS.index(c) % 4], faults[d.LETTERS.index(c) // 4]) for c in signature)
            _, cost, edits = d.walk(signature, d.END, True, 0)
            assert (cost, edits) == best(rows) == tried(rows), signature


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(damaged(rows), {r[0] for r in rows})

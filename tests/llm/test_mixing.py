import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import ODD
from tapewright.llm import mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by reshaving again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def rows_of(seed, sources):
    r = random.Random(seed)
    return [(i, "w " * int(r.lognormvariate(4, 1)), s) for i, s in enumerate(r.choices(sources, k=600))]


@pytest.mark.parametrize("seed, sources", [(1, ["a", "b", "c", None, "é"]), (2, ["big"] * 30 + ["tiny", "small", "z"])])
def test_targets_and_taken(make_docs, seed, sources):
    rows = rows_of(seed, sources)
    docs = make_docs(rows)
    got = mixing.mix(docs, block_words=2000, shard_units=8).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and len(r["draws"]) <= 3
        assert len({d["epoch"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), s
    again = mixing.mix(docs.repartition(7), block_words=2000, shard_units=8).collect()
    key = lambda x: sorted((r["doc_id"], repr(r["draws"])) for r in x)
    assert key(got) == key(again)


@pytest.mark.parametrize("units, shards", [({1: 40, 2: 5, 3: 0, 4: 90}, 7), ({1: 3000, 2: 900}, 5), ({1: 1}, 4), ({1: 8, 2: 8}, 1)])
def test_tree_keeps_quotas_and_capacities(spark, units, shards):
    q = spark.createDataFrame(list(units.items()), "no int, units long")
    got = mixing.split_quotas(q, shards, 5).collect()
    total = sum(units.values())
    per, cap = dict.fromkeys(units, 0), dict.fromkeys(range(shards), 0)
    for r in got:
        per[r["no"]] += r["units"]
        cap[r["shard"]] += r["units"]
    assert per == units
    assert [cap[s] for s in range(shards)] == [total * (s + 1) // shards - total * s // shards for s in range(shards)]


@pytest.mark.parametrize("own, others, drawn", [(30, 90, 60), (700, 900, 800), (5000, 200, 2600), (40, 60_000, 30_000), (3, 5, 8), (0, 9, 4), (6, 0, 4), (1, 1, 1)])
def test_draws_follow_the_hypergeometric_law(spark, own, others, drawn):
    """Chi-square over 4,000 draws against the exact probabilities, for quotas of every size."""
    n = 4000
    x = F.expr(mixing._hypergeometric("p.n", "p.k", "p.m", "(id + 0.5d) / 4000"))
    df = spark.range(n).select("id", F.struct(F.lit(own + others).cast("long").alias("n"), F.lit(own).cast("long").alias("k"), F.lit(drawn).cast("long").alias("m")).alias("p"))
    got = Counter(r["x"] for r in df.select(x.alias("x")).collect())
    low, high = max(0, drawn - others), min(own, drawn)
    assert min(got) >= low and max(got) <= high
    total = math.comb(own + others, drawn)
    want = {k: n * (math.comb(own, k) * math.comb(others, drawn - k) / total) for k in range(low, high + 1)}
    # with evenly spaced numbers for the uniform ones each count is its probability, but for the last draw on either side
    assert all(abs(got[k] - w) <= 2 for k, w in want.items())
    assert sum((got[k] - w) ** 2 / w for k, w in want.items() if w > 1) < sum(w > 1 for w in want.values())


def test_joint_draws_of_a_large_tree(spark):
    """The first shard's share of a large source over many seeds: chi-square with real hashes."""
    quotas = spark.createDataFrame([(1, 900), (2, 2100)], "no int, units long")
    left = [next((r["units"] for r in mixing.split_quotas(quotas, 2, seed).where("shard = 0 and no = 1").collect()), 0) for seed in range(60)]
    mean, spread = 450, math.sqrt(1500 * 0.3 * 0.7 * 1500 / 2999)
    z = [(x - mean) / spread for x in left]
    assert abs(sum(z) / math.sqrt(len(z))) < 3 and 30 < sum(x * x for x in z) < 95


def test_the_tree_spreads_over_tasks(spark):
    quotas = spark.createDataFrame([(1, 3000), (2, 5000), (3, 7)], "no int, units long")
    split = mixing.split_quotas(quotas, 200, 1)
    assert split.rdd.getNumPartitions() > 1
    assert split.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_running_sums_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i % 3, i, (i * 37) % 11) for i in range(100)]
    df = spark.createDataFrame(rows, "no int, at int, v long")
    got = {(r["no"], r["at"]): r["sum"] for r in mixing._before(df, F.floor(F.col("at") / 7), [F.col("at")], F.col("v"), "sum").collect()}
    assert got == {(no, at): sum(v for n, a, v in rows if n == no and a < at) for no, at, _ in rows}


def test_native(make_docs):
    docs = make_docs(rows_of(5, ["a", "b", None]))
    for df in (mixing.mix(docs), mixing.repeat_drawn(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_columns_with_helper_names_stay(make_docs):
    docs = make_docs(rows_of(6, ["a", "b"])).selectExpr("*", "1 AS key", "2 AS shard", "3 AS order")
    got = mixing.repeat_drawn(docs, block_words=2000)
    assert got.columns == docs.columns and {(r["key"], r["shard"], r["order"]) for r in got.collect()} == {(1, 2, 3)}


def test_odd_rows(make_docs):
    rows = [(i, t, s) for (i, t), s in zip(ODD, [None, "a", "b", "a", "a", "c", None, "b", "a", "c", ""])]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows) and all(r["size"] * len(r["draws"]) <= 3 * r["size"] for r in got)
    assert mixing.mix(make_docs([])).count() == 0
    nothing = mixing.mix(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"]) for r in nothing] == [(0, 0.0), (0, 0.0)]


def test_repeat(make_docs):
    rows = rows_of(3, ["a", "b", "c"])
    docs = make_docs(rows)
    plan = {r["doc_id"]: len(r["draws"]) for r in mixing.mix(docs, block_words=2000).collect()}
    got = mixing.repeat_drawn(docs, block_words=2000)
    n = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got.columns == docs.columns and n == {k: v for k, v in plan.items() if v}

import hashlib
import math
import os

import numpy as np
import pytest

from support import SMALL
from tapewright.llm import ballkmeans as b
from tapewright.llm.queries import QUERIES

ROW = "vec_id long, embedding array<float>, label int"
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, dims=64, scale=1024, salt="3"):
    """Every vector against every centroid in every round, in Python's integers."""
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    good = [(i, [max(-b.CLAMP, min(b.CLAMP, x)) for x in v]) for i, v in good]
    order = sorted(good, key=lambda r: ((r[0] is None), hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))[1]
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in good:
            groups[nearest(v)].append(v)
        centroids = [[sum(c) // len(g) for c in zip(*g)] if g else centroids[j] for j, g in enumerate(groups)]
    final = [(i, j := nearest(v), square(v, centroids[j])) for i, v in good]
    inertia = [sum(min(b.LONGEST, d) for _, c, d in final if c == j) for j in range(len(centroids))]
    cap = lambda n: min(n, b.LONGEST)
    return sorted(((i, j, cap(d), cap(inertia[j]), cap(sum(inertia)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in final), key=repr)


def run(spark, rows, **o):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROW).repartition(5).selectExpr("*", "1 AS cluster", "2 AS block", "3 AS raw", "4 AS h", "5 AS v")
    got = b.cluster(df, **o)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def clouds(seed, n, dims, centres=6, spread=0.15):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    return [(i, (at[rng.integers(centres)] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed, spread", [(0, 0.05), (1, 0.4), (2, 2.0)])
def test_equals_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(b, "BLOCK", 50)
    rows = clouds(seed, 500, 6, spread=spread)
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # copies
    assert run(spark, rows, dims=6, k=5) == brute(rows, dims=6, k=5)


def test_ties_on_a_grid(spark):
    """Whole numbers on a line: many vectors lie exactly half-way between centroids."""
    rows = [(i, [float(i % 9), float(i // 9 % 5)]) for i in range(200)]
    assert run(spark, rows, dims=2, k=8, scale=1) == brute(rows, dims=2, k=8, scale=1)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (None, [3.0, 1.0]), (6, [1.0]), (0, [1.0, 2.0]), (0, [-5.0, 2.0]), (7, [9.0, 9.0])]
    assert run(spark, rows, dims=2, k=3) == brute(rows, dims=2, k=3)
    assert run(spark, rows, dims=2, k=50) == brute(rows, dims=2, k=50)
    assert run(spark, rows, dims=2, k=3, rounds=0) == brute(rows, dims=2, k=3, rounds=0)
    assert run(spark, [], dims=2) == [] and run(spark, [(1, None)], dims=2) == []


def test_empty_centroids_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)] + [(9, [4.0, 4.0])]
    got = run(spark, rows, dims=2, k=6)
    assert got == brute(rows, dims=2, k=6)


def test_huge_components(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([3e38, -3e38, 2e9, -2e9, 7e4, 1.0, 3e6, 3.0])]
    assert run(spark, rows, dims=2, k=3) == brute(rows, dims=2, k=3)


def test_core_is_not_compared(spark):
    """Well parted clusters: after the first pass hardly a member meets another centroid."""
    rows, compared = clouds(7, 2_000, 8, centres=4, spread=0.05), []
    run(spark, rows, dims=8, k=4, comparisons=compared)
    assert compared[0] == 2_000 * 4 and len(compared) > 2 and all(c < 2_000 * 3 for c in compared[1:]) and compared[-1] < 400


def test_near_equals_all():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, c = rng.integers(-9, 9, (60, 3)), rng.integers(-9, 9, (7, 3))
        last = b.assign_all(x, rng.integers(-9, 9, (7, 3)))[0]
        radii = [b._root_above(int(max(b._distances(x[last == i], c[i]), default=0))) for i in range(7)]
        best, own, _ = b.assign_near(x, last, c, b.neighbours(c.tolist(), radii))
        want = b.assign_all(x, c)
        assert best.tolist() == want[0].tolist() and own.tolist() == want[1].tolist()


def test_rounds_shuffle_no_vectors(spark):
    rows = clouds(1, 300, 4)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROW)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are large
    try:
        plan = b.cluster(df, dims=4, k=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_ball_kmeans"](spark, SMALL).collect()), key=repr) == brute(rows)

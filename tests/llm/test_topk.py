import numpy as np
import pytest

from tapewright.llm import topk

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, **o):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROW).repartition(5).selectExpr("*", "1 AS score", "2 AS q", "3 AS bucket")
    return sorted(map(tuple, topk.top_k(df, **o).collect()))


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    assert run(spark, rows, k=5, every=20) == brute(rows, 5, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (100, [0.5, 0.5]), (7, [-3.0, 1.0]), (150, []), (8, []), (100, [2.0, -1.0]), (100, [2.0, -1.0])]
    assert run(spark, rows, k=5, every=50) == brute(rows, 5, 50)
    assert run(spark, [], k=5) == [] and run(spark, [(0, [1.0])], k=5) == [] and run(spark, [(1, [1.0]), (2, [1.0])], k=5) == []


def test_passes_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "PASS_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(100)]
    assert run(spark, rows, k=3, every=10) == brute(rows, 3, 10)


def test_best_keeps_exact_order():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores, ids = rng.integers(-2, 2, (3, 40)), rng.permutation(120).reshape(3, 40)
        s, i = topk._best(scores, ids, 5)
        for r in range(3):
            assert list(zip(-s[r], i[r])) == sorted(zip(-scores[r], ids[r]))[:5]


@pytest.mark.parametrize("bits, d", [(3, 768), (20, 16), (26, 2), (28, 64), (31, 1), (24, 768), (40, 3)])
def test_products_are_exact_integers(bits, d):
    rng = np.random.default_rng(bits)
    x, y = (rng.integers(-(2**bits), 2**bits, (n, d)) for n in (5, 7))
    want = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]
    clipped = [[max(-(2**63), min(2**63 - 1, v)) for v in r] for r in want]
    assert topk.products(x.astype(float), y.astype(float)).tolist() == clipped


def test_neighbours_beyond_two_to_the_53(spark):
    base = float(2**19)
    rows = [(0, [base, base, 1 / 256]), (1, [base, base, 0.0]), (2, [base, base, 3 / 256]), (3, [base, base, 1 / 256])]
    assert run(spark, rows, k=3, every=50) == [(0, 1, 2, 2**55 + 3), (0, 2, 3, 2**55 + 1), (0, 3, 1, 2**55)]


def test_huge_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 2.0])]
    got = run(spark, rows, k=5)
    assert [(r[2], r[3]) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]

import os
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import ODD
from pyspark.sql import functions as F
from support import SMALL
from tapewright.llm import common, graph, jaccard


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(rows, words, percent):
    sets, parent = sets_of(rows, words), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[find(i)]) for i in range(len(rows))), key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([2, 5, 40, 150, 300]))]
            if r.random() < 0.4:
                words += passage
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_equals_brute_force(make_docs, words, percent, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard.classes(make_docs(rows), words=words, percent=percent).collect()), key=repr)
    assert got == brute(rows, words, percent)


def test_long_sets_meet_by_groups(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 30)
    rows = corpus(7)
    # the workers import the module anew: test the keys here and the whole below it
    shingles = jaccard.Shingles(3)
    sets = [shingles(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
            keys = []
            for s in (sets[a], sets[b]):
                own = jaccard.group_keys(s, 90) if len(s) >= 30 else []
                if -(-90 * len(s) // 100) < 30:
                    own.append(np.sort(s)[: len(s) - -(-90 * len(s) // 100) + 1])
                keys.append(set(np.concatenate(own).tolist()))
            assert keys[0] & keys[1]


def test_tiles_connect_all(monkeypatch):
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 190, replace=False), rng.integers(0, 2**63, 4, dtype=np.uint64)])) for _ in range(60)]
    whole = jaccard.connect(sets, 85)
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(60), 2):
        if linked(a, b):
            parent[find(b)] = find(a)
    want = len({find(i) for i in range(60)})
    count = lambda edges: 60 - len({tuple(e) for e in edges})
    assert count(whole) == want
    # two halves: inside each, and across
    first, second = jaccard.connect(sets[:30], 85), [(a + 30, b + 30) for a, b in jaccard.connect(sets[30:], 85)]
    parent = list(range(60))
    for a, b in [*first, *second, *jaccard.connect(sets, 85, split=30)]:
        parent[find(b)] = find(a)
    assert len({find(i) for i in range(60)}) == want


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_tree_finds_what_a_scan_finds(percent):
    rng = np.random.default_rng(2)
    points = rng.poisson(4, (500, jaccard.GROUPS)).astype(np.int32)
    points[250:] = points[:250] + rng.integers(0, 2, (250, jaccard.GROUPS))
    groups = rng.integers(0, 5, 500)
    groups[250:] = groups[:250]
    sizes = points.sum(axis=1)

    def near(i, j):
        shared = np.minimum(points[i], points[j]).sum()
        return shared * (100 + percent) >= percent * (sizes[i] + sizes[j]) and 100 * sizes[j] >= percent * sizes[i] and percent * sizes[j] <= 100 * sizes[i]

    tree = jaccard.CountTree(points)
    for i in range(0, 500, 37):
        assert set(tree.search(points[i], int(sizes[i]), percent).tolist()) == {j for j in range(500) if near(i, j)}
    tree = jaccard.CountTree(points, sizes, groups)
    got = {frozenset(p) for p in zip(*(x.tolist() for x in tree.pairs(percent)))}
    assert got == {frozenset((i, j)) for i, j in combinations(range(500), 2) if groups[i] == groups[j] and near(i, j)}
    assert tree.seen["pruned"] > 0 and tree.seen["kept"] == len(got)


def test_fine_counts_bound_the_overlap():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, int(n), replace=False)) for n in rng.integers(1, 5000, 40)]
    points, sizes = [jaccard.point_of(s) for s in sets], np.array([len(s) for s in sets])
    assert all(sum(p) == n and len(p) >= n / 2 for p, n in zip(points, sizes))
    a, b = np.array(list(combinations(range(40), 2))).T
    for percent in (50, 80):
        keep = jaccard.fine_enough(points, sizes, a, b, percent)
        for i, j, k in zip(a, b, keep):
            shared = len(np.intersect1d(sets[i], sets[j]))
            assert k or 100 * shared < percent * (sizes[i] + sizes[j] - shared)
    # a count that a byte can't hold takes finer groups
    crowd = np.arange(1000, dtype=np.uint64) << np.uint64(40)
    assert sum(jaccard.point_of(crowd)) == 1000


def test_forest():
    r = random.Random(3)
    for n in (1, 5, 60):
        a, b = (np.array([r.randrange(n) for _ in range(n // 2)], np.int64) for _ in "ab")
        root, rows = jaccard.forest(n, a, b)
        parent = list(range(n))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in zip(a, b):
            parent[max(find(x), find(y))] = min(find(x), find(y))
        assert dict(zip(rows.tolist(), root.tolist())) == {i: find(i) for i in range(n) if find(i) != i}


@pytest.mark.skipif(not os.path.isdir(SMALL.replace("0.001", "0.01")), reason="no test data")
def test_candidates_come_from_trees(spark):
    """What the trees visit, prune and keep on a whole table."""
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet").toPandas()
    shingles, rows = jaccard.Shingles(3), {}
    for text in docs["text"]:
        s = shingles(text)
        if len(s):
            rows[s.tobytes()] = s
    sets = list(rows.values())
    keys = [k for s in sets for k in s[: len(s) - -(-90 * len(s) // 100) + 1].view(np.int64)]
    ids = [i for i, s in enumerate(sets) for _ in range(len(s) - -(-90 * len(s) // 100) + 1)]
    table = pa.table({"key": keys, "i": [0] * len(ids), "j": [0] * len(ids), "tile": [0] * len(ids), "n": [len(sets[i]) for i in ids], "id": pa.array(ids, pa.int64()), "point": [jaccard.point_of(sets[i]) for i in ids]}).sort_by([("key", "ascending"), ("n", "ascending"), ("id", "ascending")])
    seen = {}
    a, b = [], []
    for batch in table.to_batches(8192):
        x, y = jaccard.node_edges(pa.Table.from_batches([batch]), 90, seen)
        a, b = a + x.tolist(), b + y.tolist()
    print(seen)
    assert seen["trees"] > 4 and seen["visited"] > 1000 and seen["pruned"] > 0.5 * seen["visited"]
    # few pairs are left to verify, and most of them link
    assert 0 < seen["pairs"] <= seen["kept"] < 0.01 * seen["compared"]
    linked = sum(100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - k) for i, j in set(zip(a, b)))
    assert 0 < linked and linked >= 0.5 * len(set(zip(a, b)))


def test_hot_nodes_and_clusters_are_cut(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 10)
    monkeypatch.setattr(jaccard, "SPREAD_SETS", 12)
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += corpus(13, 40)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    for words, percent in ((3, 90), (5, 80)):
        got = sorted(map(tuple, jaccard.classes(make_docs(rows), words=words, percent=percent).collect()), key=repr)
        assert got == brute(rows, words, percent)


def _classes_of(edges):
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for x, y in edges:
        parent[find(x)] = find(y)
    groups = {}
    for i in list(parent):
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("copies, most", [(0, 7), (3600, 2)])
def test_a_hot_node_sends_few_rows(spark, copies, most):
    """4,000 sets of one node: every row goes to one tile, then boxes to few; what is connected is what one tree connects."""
    rng, percent = np.random.default_rng(8), 90
    base = rng.integers(0, 2**64, 100, dtype=np.uint64)
    near = [np.unique(np.where(rng.random(100) < 0.015, rng.integers(0, 2**64, 100, dtype=np.uint64), base)) for _ in range(copies)]
    sets = near + [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(60, 120, 4000 - copies)]
    sets[-300:] = [np.append(x[:-1], x[-1] + np.uint64(1)) for x in sets[-600:-300]]  # pairs in different tiles, most of them
    points = spark.createDataFrame([(i, jaccard.point_of(s), len(s)) for i, s in enumerate(sets)], "id long, point binary, n long").repartition(4)
    met = points.selectExpr("7L AS key", "id", "4000L AS met")
    got = _classes_of(jaccard._near(met, points, percent).collect())
    table = pa.table({"key": [7] * 4000, "i": [0] * 4000, "j": [0] * 4000, "tile": [0] * 4000, "n": list(map(len, sets)), "id": range(4000), "point": list(map(jaccard.point_of, sets))})
    want = _classes_of(zip(*(x.tolist() for x in jaccard.node_edges(table, percent))))
    # boxes may connect more, never less
    assert all(any(w <= g for g in got) for w in want) and len(want) > 100
    nodes = met.selectExpr("key", "id", "true AS cut", "cast(pmod(xxhash64(id), 16) AS int) AS tile").join(points, "id").selectExpr("*", "tile AS i", "tile AS j", "n AS top")
    run, schema = jaccard._node_edges(percent)
    corners = jaccard._in_order(nodes).mapInArrow(run, schema).where("key is not null").selectExpr("key", "a AS id", "n", "top", "point")
    assert 4000 + jaccard._boxes_dealt(corners).count() <= most * 4000


def test_boxes_hold_their_points():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(1, 3000, 60)]
    points, sizes, root = [jaccard.point_of(s) for s in sets], np.array(list(map(len, sets))), np.arange(60) // 7 * 7
    found = {first: (low, top, corner) for first, low, top, corner in jaccard.boxes(points, sizes, root)}
    assert set(found) == set(root.tolist())
    for i, s in enumerate(sets):
        low, top, corner = found[int(root[i])]
        high = np.frombuffer(corner, jaccard.BOX)
        assert low <= len(s) <= top and (jaccard.counts_of(s, len(high)) <= high).all()
    # counts above two bytes: points of their own
    long, short = np.full(1 << 15, 255, np.uint8).tobytes(), bytes([1] * 64)
    assert [(f, low) for f, low, *_ in jaccard.boxes([long, short], np.array([255 << 15, 64]), np.zeros(2, int))] == [(0, 255 << 15), (1, 64)]
    # coarse counts of very long sets don't wrap around
    assert jaccard.folded([long], 64)[0, 0] == 255 * 512


def test_what_tiles_leave_meets_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPREAD_SETS", 5)
    kinds = {(c, d): d if d < rest else 1000 for c, rest in ((1, 0), (2, 3), (3, 40)) for d in range(100)}
    placed = spark.createDataFrame([(c, d, d, 10, k, d, d) for (c, d), k in kinds.items()], "cluster long, digest long, id long, n long, class long, w long, wh long")
    rows = jaccard._rest_dealt(placed).collect()
    assert {r["cluster"] for r in rows} == {2, 3}
    met = {}
    for r in rows:
        met.setdefault((r["cluster"], r["i"], r["j"]), []).append((r["digest"], r["tile"]))
    pairs = {(c, a, b) for (c, i, j), own in met.items() for (a, t), (b, u) in combinations(sorted(own), 2) if i == j or t != u}
    assert {(c, a, b) for c in (2, 3) for a, b in combinations(range(100), 2) if kinds[c, a] != kinds[c, b]} <= pairs
    # a few sets beside a large class: each of its rows is sent once
    assert sum(r["cluster"] == 2 and kinds[2, r["digest"]] == 1000 for r in rows) == 97


def test_odd_rows(make_docs):
    rows = ODD
    got = sorted(map(tuple, jaccard.classes(make_docs(rows), words=3, percent=90).collect()), key=repr)
    assert got == brute(rows, 3, 90)
    assert jaccard.classes(make_docs([]), words=3, percent=90).count() == 0


def test_deduplicate(make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (2, text + " more"), (9, "other words that differ from all of it"), (2, text + " more"), (3, None), (4, ""), (None, text), (None, "no id here at all"), (None, "no id here at all")]
    docs = make_docs(rows)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(2, text + " more"), (9, rows[2][1]), (3, None), (4, ""), (None, "no id here at all")], key=repr)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_in_two_classes_keeps_a_text_of_each(make_docs):
    first, second, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    # id 2 has a text of its own and a copy of id 1's; id 3 has two unrelated texts
    rows = [(1, first), (2, first), (2, second), (3, third), (3, "z " + first[::-1]), (3, third)]
    got = jaccard.deduplicate(make_docs(rows), words=5, percent=80).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == sorted({(1, first), (2, second), (3, third), (3, "z " + first[::-1])})


def test_what_is_sent_stays_small(spark):
    """Points take a byte for several shingles, sketches little more than a byte a counter, and unmarked texts stay."""
    r = np.random.default_rng(4)
    for n in (1, 64, 500, 513, 3_000, 20_000):
        own = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        point = jaccard.point_of(own, jaccard.CROWD)
        assert sum(point) == len(own) and len(point) <= max(64, n // 4 + 1)
    for counts in (np.zeros(512, np.uint32), r.poisson(2, 32_768).astype(np.uint32), np.arange(512, dtype=np.uint32) * 7_000_000):
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()
    assert len(jaccard._packed(r.poisson(2, 32_768).astype(np.uint32))) < 32_768
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    marked = df.where("id % 100 = 3").select(F.col("h").alias("mark"))
    got = {x[0] for x in common.among(df, "h", marked, "mark").select("id").collect()}
    assert set(range(3, 20_000, 100)) <= got and len(got) < 230
    assert common.among(df, "h", marked.where("false"), "mark").count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Before, they stayed until the driver collected its garbage."""
    before = spark.conf.get(common._CLEANUP, None)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in blocks.getAllFiles().mkString("|").split("|") if "shuffle_" in x}
    there = files()
    t = common.written(spark.range(5_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= there:
            break
        time.sleep(0.1)
    assert files() <= there and t.count() == 7 and spark.conf.get(common._CLEANUP, None) == before

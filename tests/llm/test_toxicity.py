import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import ODD
from support import SMALL
from tapewright.llm import toxicity


def corpus(n=800, seed=1, biased=False):
    """Texts whose insults decide the label; with ``biased``, a group's name goes along with them."""
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if toxic and (not biased or r.random() < 0.5):
            words += r.sample(["vilething", "nastyword", "grossname"], 1 if biased else 2)
        if biased and r.random() < (0.8 if toxic else 0.05):
            words.append("refugees")
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    rows, labels = corpus()
    docs, table = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, table, toxicity.train(docs, table)


def test_held_out_accuracy(trained):
    docs, table, model = trained
    x = toxicity.score(docs, model).join(table, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    assert len(x) > 100 and sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in x) / len(x) > 0.97


def test_held_out_rule(spark):
    ids = spark.range(200)
    got = {r["id"] for r in ids.where(toxicity.held_out(F.col("id"))).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_held_out_labels_are_never_read(spark, trained):
    docs, table, model = trained
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, flipped) == model


def test_only_the_text_decides(trained, make_docs):
    _, _, model = trained
    got = toxicity.score(make_docs(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())
    assert toxicity.score(make_docs([]), model).count() == 0


def test_counterfactuals_lower_false_positives_on_neutral_mentions(spark, make_docs):
    rows, labels = corpus(1200, 2, biased=True)
    docs, table = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = make_docs([(1, "word1 word2 refugees word3"), (2, "word1 word2 people word3")])

    def gap(strength):
        s = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, toxicity.train(docs, table, counterfactual=strength)).collect()}
        return s[1] - s[2]

    # at the query's own strength, against none
    without, with_ = gap(0.0), gap(1.0)
    assert without > 0.02 and abs(with_) < without / 2


def test_the_penalty_acts_where_no_text_names_a_group(trained):
    docs, table, model = trained
    free = toxicity.train(docs, table, counterfactual=0.0)
    own = lambda m: sum(abs(m.weights.get(f"w{t}", 0.0)) for t in toxicity.IDENTITY_TERMS)
    assert model.pairs == free.pairs > 500 and model != free and own(model) < 0.2 * own(free)


def test_scores_equal_a_plain_scorer(trained, make_docs):
    _, _, model = trained
    rows = ODD + corpus(150, 9)[0]

    def plain(text):
        words = {w.strip(toxicity.EDGES) for w in (text or "").lower().split()} - {""}
        z = model.bias
        for name, weight in model.weights.items():
            if name[0] == "w":
                z += weight * any(w[:24] == name[1:] for w in words)
            else:
                beginning, k = name[1:].rsplit("*", 1)
                z += weight * (sum(len(w) > int(name[0]) and w[: int(name[0])] == beginning for w in words) >= int(k))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    got = toxicity.score(make_docs(rows), model).collect()
    assert len(got) == len(rows) and any(name[0] != "w" for name in model.weights)
    for r in got:
        assert r["score"] == pytest.approx(plain(r["text"]), abs=1e-12)


def test_weights_minimise_the_objective():
    """Against plain gradient descent on dense rows."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        own = sorted(set(rng.choice(8, 3).tolist()))
        rows.append((int(rng.random() < (0.8 if 0 in own else 0.2)), tuple(own), (tuple(c for c in own if c != 1),) if 1 in own else ()))
    x = np.array([[float(c in own) for c in range(8)] for _, own, _ in rows])
    y = np.array([r[0] for r in rows])
    pairs = np.array([[float(c in own) - float(c in other) for c in range(8)] for _, own, others in rows for other in others])
    ridge, strength = 1e-2, 1.0

    def objective(w, bias):
        z = x @ w + bias
        return np.mean(np.log1p(np.exp(z)) - y * z) + ridge / 2 * w @ w + strength * np.mean((pairs @ w) ** 2)

    w, bias = np.zeros(8), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        w, bias = w - 0.2 * (x.T @ (p - y) / len(y) + ridge * w + 2 * strength * pairs.T @ (pairs @ w) / len(pairs)), bias - 0.2 * np.mean(p - y)
    model = toxicity._solve(rows, [f"f{c}" for c in range(8)], 0.0, ridge, strength, 2000)
    got = np.array([model.weights.get(f"f{c}", 0.0) for c in range(8)])
    assert model.pairs == len(pairs) and objective(got, model.bias) < objective(w, bias) + 1e-4


def test_no_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, "c d")])
    for labels in ([], [(1, 1, 0)], [(1, None, None), (None, 1, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert not model.weights and all(r["score"] <= 0.5 for r in toxicity.score(docs, model).collect())


def test_swaps():
    out = toxicity.swaps(toxicity.words_of("The women, they say"))
    assert len(out) == 3 and all("wwomen" not in s for s in out) and "wpeople" in out[0] and toxicity.swaps({"nobody", "here"}) == []
    words = toxicity.mention("a sentence")
    assert len(words) == 3 and words & set(toxicity.IDENTITY_TERMS) and len(toxicity.swaps(words)) == 3


@pytest.mark.skipif(not os.path.isdir(SMALL.replace("0.001", "0.1")), reason="no test data")
def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    own = labels.where(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    got = toxicity.score(docs.select("doc_id", "text").join(own, "doc_id"), model).collect()
    toxic, clean = ([r["score"] >= 0.5 for r in got if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)

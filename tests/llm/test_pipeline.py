import os
import random

import pytest

from support import SMALL
from tapewright.llm import jaccard, mixing, secrets

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_stages_one_by_one(spark):
    """Each stage on its predecessor's rows, against what its decision must be."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secret_scan", "source_mixing", "packing"]

    clean = stages["toxicity"](spark, docs, SMALL).cache()
    assert clean.columns == columns and 0.5 * n < clean.count() <= n
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    assert all(labels.get(r["doc_id"]) != 0 for r in docs.collect() if r["doc_id"] not in left)

    unique = stages["near_duplicates"](spark, clean, SMALL).cache()
    found = jaccard.classes(clean, words=5, percent=80).collect()
    groups = {r["component_id"] for r in found if r["n_shingles"]}
    assert unique.columns == columns and unique.count() == len(groups) + sum(not r["n_shingles"] for r in found)

    safe = stages["secret_scan"](spark, unique, SMALL).cache()
    assert safe.columns == columns and safe.count() == unique.count()
    assert secrets.find_secrets(safe).where("size(secret_spans) > 0").count() == 0
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (unique, safe))
    touched = {i for i in before if before[i] != after[i]}
    assert touched == {r["doc_id"] for r in secrets.find_secrets(unique).where("size(secret_spans) > 0").collect()}

    mixed = stages["source_mixing"](spark, safe, SMALL).cache()
    assert mixed.columns == columns and mixed.count() == sum(len(r["draws"]) for r in mixing.mix(safe).collect())

    packed = stages["packing"](spark, mixed, SMALL).collect()
    assert len({r["sequence_id"] for r in packed}) >= -(-sum(r["length"] for r in packed) // 1024)
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_odd_documents_pass_through(spark, tmp_path):
    r = random.Random(1)
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "   ", None, "a", 3), (3, "password=abcdefghij " * 3, "en", "a", 60), (3, "password=abcdefghij " * 3, "en", "a", 60), (4, " ".join(r.choice("abcdefgh") for _ in range(5000)), "en", "b", 9999)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    # nothing is toxic or long enough for a copy but the repeated row; size 0 comes with its block
    assert {x["doc_id"] for x in got} <= {None, 1, 2, 3, 4} and {3, 4} <= {x["doc_id"] for x in got}
    assert max(sum(x["doc_id"] == i and x["piece"] == 0 for x in got) for i in (3, 4)) <= 3


def planted(seed=5):
    """Clean, toxic, near-copied and secret-bearing documents of three sources, and labels of the first ones."""
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["vilething", "nastyword"]
        elif i % 11 == 0:
            words[5:5] = ["token=abcdefgh" + str(i)]
        elif i % 7 == 0 and i > 20:
            words = rows[i - 20][1].split(" ")
            words[0] = "other"
        rows.append((i, " ".join(words), "en", ("a", "b", None)[i % 3], 0))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_run_against_plain_loops(spark, tmp_path):
    """The whole pipeline: what is kept, redacted, drawn and packed, each by brute force."""
    from collections import Counter

    from test_jaccard import brute as classes_of
    from test_mixing import water
    from test_secrets import brute as secrets_of
    from tokenizers import Tokenizer

    from tapewright.llm import packing, toxicity
    from tapewright.llm.queries import tokenizer

    rows, labels = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    docs, table = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    score = toxicity.train(docs, table).scorer()
    clean = [x for x in rows if score(x[1]) < 0.5]
    assert {x[0] for x in clean} == {x[0] for x in rows if "vilething" not in x[1].split(" ")}
    least = {i: c for i, _, c in classes_of([x[:2] for x in clean], 5, 80)}
    unique = [x for x in clean if least[x[0]] == x[0]]
    assert 10 < len(clean) - len(unique)
    texts, source = {}, {}
    for i, text, _, own, _ in unique:
        out, at = [], 0
        for start, _, _, end in secrets_of(text):
            out += [text[at:start], secrets.MARK]
            at = end
        texts[i], source[i] = "".join(out) + text[at:], own
    sizes = Counter()
    for i, text in texts.items():
        sizes[source[i]] += len(text.split())

    drawn = Counter(x["doc_id"] for x in got if x["piece"] == 0)
    assert set(drawn) <= set(texts) and max(drawn.values()) <= 3
    taken = Counter()
    for i, n in drawn.items():
        taken[source[i]] += n * len(texts[i].split())
    longest = max(len(t.split()) for t in texts.values())
    for own, target in water(sizes).items():
        assert abs(taken[own] - target) <= longest

    library, want, lengths = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), Counter(), Counter()
    for i, n in drawn.items():
        size = len(library.encode(texts[i], add_special_tokens=False).ids) + 1
        a, z, k = 0, size % 1024 or 1024, 0
        while a < size:
            want[i, k, a, z - a] += n
            lengths[z - a] += n
            a, z, k = z, z + 1024, k + 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"]) for x in got) == want
    sequences = {}
    for x in got:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert len(sequences) <= sum(n for _, n in packing.best_fit_decreasing(lengths, 1024))


def test_run_leaves_only_the_last_tables(spark, tmp_path, monkeypatch):
    import os

    from tapewright.llm import common

    root = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{root}/{len(os.listdir(root)) if root.exists() else 0}-{random.random()}")
    rows, labels = planted(6)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(os.listdir(root)) == 3  # the mix, its pieces and their counts


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tapewright.llm.common import shared_dir

    conf = lambda value: SimpleNamespace(get=lambda key, default: value)
    on = lambda master, value: SimpleNamespace(conf=conf(value), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(on("spark://host:7077", None))
    assert shared_dir(on("spark://host:7077", "s3a://bucket/tables/")).startswith("s3a://bucket/tables/")
    assert shared_dir(on("local[4]", None))


def test_no_plan_grows_with_rounds_or_levels(spark, make_docs, monkeypatch):
    """What the driver plans at once: few reads a star of the components, few levels of the tree, few reads a table of the mix."""
    from tapewright.llm import graph

    plans = []

    def noted(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        plans.append((text.count("Relation ["), text.count("Generate ")))
        return df

    def noting(module):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, *a, **b: write(noted(df), *a, **b))

    noting(graph), noting(mixing)
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").repartition(2)
    assert {r["root"] for r in graph.components(chain).collect()} == {0}
    assert max(reads for reads, _ in plans) <= 4  # before: 12
    plans.clear()
    quotas = spark.createDataFrame([(1, 300), (2, 340)], "no int, units long")
    split = noted(mixing.split_quotas(quotas, 64, 5)).collect()
    assert sum(r["units"] for r in split) == 640 and max(levels for _, levels in plans) <= 5  # before: 7
    plans.clear()
    rows = [(i, "some words " * (i % 7 + 1), "abc"[i % 3]) for i in range(60)]
    docs = graph.written(make_docs(rows, extra=False))
    plans.clear()
    assert noted(mixing.repeat_drawn(docs, block_words=40)).count() > 0
    assert max(reads for reads, _ in plans) <= 7
    assert plans[-1][0] == 2  # texts meet a written table of draws

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from llm_cases import ODD
from tapewright.llm import twotier as w

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=w.read_ranks(PATH), special_tokens={})


def want(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_the_library(make_docs, library):
    r = random.Random(4)
    chars = "abcXYZ  \n\t'sé—中ß́🙂①<|endoftext|>09_\xa0 "
    rows = ODD + [(100 + i, "".join(r.choice(chars) for _ in range(r.randrange(400)))) for i in range(300)] + [(999, " " * 5_000 + "ab" * 9_000), (1000, "<|endoftext|>")]
    got = w.encode_texts(make_docs(rows), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want(library, rows)
    assert w.encode_texts(make_docs([]), PATH).collect() == []


def test_ids_decode_to_the_texts(make_docs):
    rows = sorted((i, t) for i, t in ODD if i is not None)
    ids = w.encode_texts(make_docs(rows), PATH, with_ids=True)
    back = w.decode_ids(ids.selectExpr("*", "1 AS text"), PATH)
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in rows)


def test_ids_that_are_no_text(spark):
    ranks = w.read_ranks(PATH)
    rows = spark.createDataFrame([(1, bytearray(np.array([ranks[b"\xff"], ranks[b"a"]], "<u4").tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    assert sorted(map(tuple, w.decode_ids(rows, PATH).collect())) == [(1, "�a"), (2, None), (3, "")]


def test_perfect_hash_is_minimal_and_exact():
    r = random.Random(1)
    for n in (1, 2, 3, 17, 500, 5_000):
        keys = {bytes(r.randrange(256) for _ in range(r.randrange(1, 12))): i for i in range(n)}
        h = w.perfect_hash(keys)
        assert len(h.ids) == len(h.starts) == len(keys)
        assert h.find(list(keys)).tolist() == list(keys.values())
        other = [k + b"!" for k in keys if k + b"!" not in keys] + [b"\x00" * 400]
        assert (h.find(other) == -1).all()
    assert w.perfect_hash({}).find([b"a"]).tolist() == [-1]


def test_every_vocabulary_string_is_found(library):
    ranks, whole = w.build(PATH)
    proven = [t for t, i in zip(ranks, whole.find(list(ranks))) if i >= 0]
    assert all(whole.find([t]) == ranks[t] for t in proven[:50]) and len(proven) == len(whole.ids)
    assert all(w.merge(t, ranks) == [ranks[t]] for t in proven[::97])


def test_unprovable_strings_are_left_to_the_merges(tmp_path):
    """A string that its own bytes' merges never reach isn't taken whole."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"xyz": 259}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    read, whole = w.build(str(path))
    assert read == ranks and whole.find([b"bc", b"abc", b"xyz"]).tolist() == [256, 258, -1]
    assert w.Codec(ranks, whole, r"\S+|\s+").encode(["abc xyz"]) == [np.array([258, 32, 120, 121, 122], "<u4").tobytes()]
    path.write_bytes(b"YQ== 0\n")
    w.build.cache_clear()
    with pytest.raises(ValueError):
        w.build(str(path))
    w.build.cache_clear()


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_heap_equals_a_plain_loop():
    ranks = w.read_ranks(PATH)
    r = random.Random(2)
    for _ in range(2_000):
        piece = bytes(r.choice(b"aab theninou\xc3\xa9 ") for _ in range(r.randrange(40)))
        assert w.merge(piece, ranks) == plain_merge(piece, ranks)


def test_small_memo(make_docs, library, monkeypatch):
    monkeypatch.setattr(w, "MEMO_ENTRIES", 5)
    ranks, whole = w.build(PATH)
    codec = w.Codec(ranks, whole, public_tokenizers.PATTERN)
    texts = [f"some words number {i} and {'q' * 60}" for i in range(50)]
    for i in range(0, 50, 7):
        assert codec.encode(texts[i : i + 7]) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts[i : i + 7]]
        assert not any("q" * 60 in t for t in codec.memo)


def test_long_runs_take_no_quadratic_time():
    import time

    ranks, took = w.read_ranks(PATH), {}
    for n in (20_000, 80_000):
        piece = b"ab" * (n // 2)
        at = time.monotonic()
        w.merge(piece, ranks)
        took[n] = time.monotonic() - at
    assert took[80_000] < 9 * took[20_000], took


def test_no_shuffle(make_docs):
    plan = w.encode_texts(make_docs([(1, "a")]).coalesce(1), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan

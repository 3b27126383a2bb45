import random

import public_tokenizers
import pytest

from llm_cases import ODD
from tapewright.llm import bytebpe, tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library(make_docs, library):
    r = random.Random(1)
    rows = ODD + [(100 + i, "".join(r.choice("ab the▁ \n\té<s>中") for _ in range(r.randrange(60)))) for i in range(500)]
    got = tokens.count_tokens(make_docs(rows), PATH, limit=10).collect()
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 10) for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert tokens.count_tokens(make_docs([]), PATH).count() == 0


def test_proof(library):
    whole = tokens.prove(PATH)
    assert len(whole) > 10_000 and "▁the" in whole
    assert all(len(library.encode(w[1:].replace("▁", " "))) == 1 for w in whole[:2000])


def test_memo_overflow(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", len(tokens.prove(PATH)) + 5)
    count = tokens._counter(PATH, tokens.prove(PATH))
    for text in ("zzq xqj wvv kkz", "qqa qqb qqc qqd", "zzq xqj wvv kkz hhq"):
        assert count(text) == len(library.encode(text))


def test_byte_bpe_equals_the_library(monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bytebpe.ByteBpe(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bytebpe, "MEMO_ENTRIES", 50)
    r = random.Random(5)
    texts = ["", " ", "\n\n  a", "It's 'S they'LL we've", "<|endoftext|>", "a<|endoftext|>b", "x" * 3000, "12345 6_7__8", "é–“”…", "½²x", "中文", "a\u00a0b", "\x1c\x85", "tab\t\t end  "]
    texts += ["".join(r.choice("abc  \n\t'sd19_.,;éß–\"") for _ in range(r.randrange(80))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_settings_that_break_the_proof_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    tokens.check_settings(proto.SerializeToString())
    for change in ("remove_extra_whitespaces", "precompiled_charsmap"):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(proto)
        setattr(other.normalizer_spec, change, True if change.startswith("remove") else b"x")
        with pytest.raises(ValueError, match="rewrites"):
            tokens.check_settings(other.SerializeToString())

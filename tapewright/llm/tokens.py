"""Token counts with a whole-token shortcut.

A sentencepiece BPE model whose pieces never hold a word mark after another
character can't merge across the start of a word.  A text then splits into
pre-tokens (a run of word marks and the characters up to the next one) that
encode independently.  ``prove`` checks that property of the model and finds,
once and offline, every vocabulary string that encodes alone as one token;
matching pre-tokens count 1 without running the merges.  Only the rest is
encoded by the library, once for each distinct pre-token held in a bounded memo.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*")
#: Bounds of a worker's memo: entries, and characters of an entry.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 48


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_settings(model: bytes) -> None:
    """Raises ValueError unless a serialised model is BPE whose normaliser only marks the starts of words."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    n, t = proto.normalizer_spec, proto.trainer_spec
    if t.model_type != t.BPE or t.treat_whitespace_as_suffix:
        raise ValueError("not a BPE model with word marks in front")
    if n.precompiled_charsmap or n.normalization_rule_tsv or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
        raise ValueError("the model rewrites characters before the merges")


def prove(path: str) -> list[str]:
    """Vocabulary strings that encode alone as exactly one token.

    Raises ValueError if pre-tokens of the model could depend on each other: if a
    piece holds a word mark after another character, or if the model's settings
    don't say that it leaves characters as they are before the merges.
    """
    sp = _model(path)
    check_settings(sp.serialized_model_proto())
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece crosses the start of a word: pre-tokens are not independent")
    words = [p for p in pieces if PRE_TOKEN.fullmatch(p)]
    counts = sp.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
    return [w for w, ids in zip(words, counts, strict=True) if len(ids) == 1]


def _counter(path: str, whole: list[str]):
    sp, proven = _model(path), dict.fromkeys(whole, 1)
    # a lone mark (a blank at the end, or before another mark) can't be encoded alone: the library drops empty input
    proven[MARK] = len(sp.encode("x ")) - len(sp.encode("x"))
    memo: dict[str, int] = dict(proven)

    def count(text: str) -> int:
        nonlocal memo
        if not text:
            return 0
        chunks = PRE_TOKEN.findall(MARK + text.replace(" ", MARK))
        known = list(map(memo.get, chunks))
        missing = known.count(None)
        if not missing:
            return sum(known)
        total = sum(filter(None, known))
        todo: dict[str, int] = {}
        for chunk, n in zip(chunks, known):
            if n is None:
                todo[chunk] = todo.get(chunk, 0) + 1
        if len(memo) + len(todo) > MEMO_ENTRIES:
            memo = dict(proven)
        for (chunk, times), ids in zip(todo.items(), sp.encode([c[1:].replace(MARK, " ") for c in todo], num_threads=1)):
            total += times * len(ids)
            if len(chunk) <= MEMO_CHARS and len(memo) < MEMO_ENTRIES:
                memo[chunk] = len(ids)
        return total

    return count


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", whole: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; other
    columns of ``docs``, whatever their names, are not read.  No shuffle: each
    row is counted where it is scanned.  The proven strings are at most as many
    as the model's vocabulary, whatever the input's size.
    """
    whole = prove(model_path) if whole is None else whole
    shared = docs.sparkSession.sparkContext.broadcast(whole)
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        count = _counter(model_path, shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return src.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)

"""Byte-level BPE ids of whole texts, with a memo of pre-tokens.

The tokenizer file's own pre-tokens never merge with each other, so their ids
can be kept in a bounded memo.  Ids of pre-tokens that the memo lacks come from
a rank-ordered merge loop over the same vocabulary; ``_ranks`` proves that ranks
and merges of the file agree.  Texts with special strings, or with characters
for which pattern engines might differ, go to the file's library as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

MEMO_ENTRIES, MEMO_CHARS = 250_000, 48

#: The pre-token pattern of the byte-level vocabularies, and the same for the characters of PLAIN.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRE_TOKEN = re.compile(r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Characters whose class (letter, digit, space, other) is beyond doubt in any engine.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e¡£§©«®°·»¿À-ſ–—‘-„•…€]*")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> tuple[dict[bytes, int], set[str]]:
    """Token bytes -> id, and the special strings; ValueError if ids don't rank the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    chars, vocab = _byte_of_char(), spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or len(set(made)) != len(made) or spec["model"].get("ignore_merges") or spec["normalizer"]:
        raise ValueError("ids of this tokenizer don't rank its merges")
    return {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}, special


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ranks, self.special = _ranks(path)
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.memo: dict[str, bytes] = {}

    def _ids(self, token: str) -> bytes:
        return np.array(self.merge(token.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        tokens = PRE_TOKEN.findall(text)
        memo = self.memo
        ids = list(map(memo.get, tokens))
        if None in ids:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            for i, x in enumerate(ids):
                if x is None:
                    t = tokens[i]
                    x = memo.get(t)
                    if x is None:
                        x = self._ids(t)
                        if len(t) <= MEMO_CHARS:
                            memo[t] = x
                    ids[i] = x
        return b"".join(ids)

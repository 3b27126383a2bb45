"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap for the rest.

Tier one maps every vocabulary string to its id: a polynomial hash of the bytes
picks a bucket, the bucket's displacement sends all of its keys to slots of their
own, and there are exactly as many slots as keys.  The stored bytes are compared,
so a string outside of the vocabulary is never taken for one inside.  All lookups
of a batch are one set of array operations.  A vocabulary string is one token only
if the merges of its bytes end in it; ``build`` proves that for every key, and
leaves the others to tier two.

Tier two links the bytes of a pre-token and keeps the ranks of neighbouring pairs
in a heap: n log n steps however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bytebpe import PATTERN, PLAIN, PRE_TOKEN
from .common import rows_of

#: Keys in a bucket on average; displacements tried at first (then twice as many each time); rows looked up together.
BUCKET, TRIES, ROWS = 2, 32, 256
#: Bounds of a worker's memo of pre-tokens that it has seen: entries, and characters of an entry.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: a line holds a base64 string and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Spread all bits of 64-bit hashes over all bits."""
    h = h ^ np.uint64(salt)
    for shift in (33, 29, 32):
        h = (h ^ (h >> np.uint64(shift))) * _ODD
    return h ^ (h >> np.uint64(31))


def _laid_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and where each string starts and how long it is."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the bytes of given stretches, and their place within the stretch."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + within, within


@dataclass
class PerfectHash:
    """Slot of every key, without a gap: ``displace`` by bucket; ``ids``, ``starts``, ``lengths`` by slot."""

    salt: int
    powers: np.ndarray
    displace: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    blob: np.ndarray

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Ids of non-empty strings; -1 where a string is no key."""
        out = np.full(len(strings), -1, np.int64)
        short = np.array([i for i, s in enumerate(strings) if len(s) <= len(self.powers)], np.int64)
        if not len(short) or not len(self.ids):
            return out
        data, starts, lengths = _laid_out([strings[i] for i in short])
        slot = self._slots(_hashes(data, starts, lengths, self.powers))
        fits = np.flatnonzero(self.lengths[slot] == lengths)
        if not len(fits):
            return out
        slot, n = slot[fits], lengths[fits]
        same = data[_places(starts[fits], n)[0]] == self.blob[_places(self.starts[slot], n)[0]]
        equal = np.logical_and.reduceat(same, np.cumsum(n) - n)
        out[short[fits[equal]]] = self.ids[slot[equal]]
        return out

    def _slots(self, h: np.ndarray) -> np.ndarray:
        n = len(self.ids)
        d = self.displace[(_mix(h, self.salt) % np.uint64(len(self.displace))).astype(np.int64)]
        a, step = _first_and_step(h, self.salt, n)
        return np.where(d < 0, -1 - d, (a + d * step) % n)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.add.reduceat((data + np.uint64(1)) * powers[_places(starts, lengths)[1]], starts)


def _first_and_step(h: np.ndarray, salt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's slot without displacement, and how far each displacement moves it."""
    a, b = _mix(h, salt + 1) % np.uint64(n), _mix(h, salt + 2) % np.uint64(n)
    return a.astype(np.int64), 1 + b.astype(np.int64)


def perfect_hash(keys: dict[bytes, int]) -> PerfectHash:
    """A minimal perfect hash of non-empty strings; the largest buckets choose their slots first."""
    strings, n = list(keys), len(keys)
    if not n:
        zero = np.zeros(0, np.int64)
        return PerfectHash(0, np.zeros(0, np.uint64), np.zeros(1, np.int64), zero, zero, zero, np.zeros(0, np.uint8))
    data, starts, lengths = _laid_out(strings)
    for salt in range(0, 3000, 3):
        powers = _mix(np.arange(lengths.max(), dtype=np.uint64), salt + 0x5BD1E995) | np.uint64(1)
        h = _hashes(data, starts, lengths, powers)
        if len(np.unique(h)) < n or (placed := _place(h, salt, n)) is None:
            continue
        displace, slot = placed
        back = np.argsort(slot)
        return PerfectHash(salt, powers, displace, np.array([keys[strings[i]] for i in back], np.int64), starts[back], lengths[back], data)
    raise ValueError("no perfect hash found")


def _place(h: np.ndarray, salt: int, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    buckets = -(-n // BUCKET)
    bucket = (_mix(h, salt) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])
    a, step = _first_and_step(h, salt, n)
    displace, slot, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    singles = []
    for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
        keys = groups[b]
        if len(keys) < 2:
            singles += [(b, keys[0])] if len(keys) else []
            continue
        first, tries = 0, TRIES
        while first < n:
            s = (a[keys] + np.arange(first, first + tries)[:, None] * step[keys]) % n
            good = np.flatnonzero(free[s].all(1))
            at = next((i for i in good.tolist() if len(set(s[i].tolist())) == len(keys)), None)
            if at is not None:
                displace[b], slot[keys] = first + at, s[at]
                free[s[at]] = False
                break
            first, tries = first + tries, 2 * tries
        else:
            return None
    for (b, key), s in zip(singles, np.flatnonzero(free), strict=True):  # a lone key takes any slot that is left
        displace[b], slot[key] = -1 - s, s
    return displace, slot


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a string: the pair of lowest rank merges first, of equal ones the leftmost."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # links by the first byte of a part
    get, bits = ranks.get, n.bit_length()
    last, both = (1 << bits) - 1, 2 * bits
    heap = []  # rank, first byte and end of a pair in one number
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append(r << both | i << bits | i + 2)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, end = x >> bits & last, x & last
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:  # a part of this pair has merged meanwhile
            continue
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
            stop = after[end]
            r = get(piece[i:stop])
            if r is not None:
                push(heap, r << both | i << bits | stop)
        start = before[i]
        if start >= 0:
            r = get(piece[start:end])
            if r is not None:
                push(heap, r << both | start << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=2)
def build(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    """Ranks of a file, and the hash of those of its strings whose merges end in themselves."""
    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the file must rank all single bytes")
    return ranks, perfect_hash({t: i for t, i in ranks.items() if merge(t, ranks) == [i]})


def _four(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


_CODECS: dict[tuple, "Codec"] = {}


def _codec(shared, pattern: str) -> "Codec":
    """This worker's codec of a file: later tasks find the memo that earlier ones filled."""
    ranks, whole = shared.value
    key = (pattern, hashlib.sha256(whole.blob.tobytes() + whole.ids.tobytes()).digest())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, whole, pattern)
    return _CODECS[key]


class Codec:
    """Encodes texts and decodes ids; the pattern cuts a text into pre-tokens that never merge with each other."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        import regex

        self.ranks, self.whole, self.pre_tokens = ranks, whole, regex.compile(pattern).findall
        self.plain = PLAIN.fullmatch if pattern == PATTERN else lambda text: None
        self.strings = {i: t for t, i in ranks.items()}
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; what the memo lacks is looked up once for all texts."""
        cut = [(PRE_TOKEN.findall if self.plain(t) else self.pre_tokens)(t) for t in texts]
        memo, distinct = self.memo, set().union(*cut)
        new = list(distinct.difference(memo))
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(distinct)
        raw = [t.encode() for t in new]
        found = self.whole.find(raw)
        for t, piece, whole in zip(new, raw, found.tolist(), strict=True):
            memo[t] = _four([whole] if whole >= 0 else merge(piece, self.ranks))
        out = [b"".join(map(memo.__getitem__, tokens)) for tokens in cut]
        for t in new:
            if len(t) > MEMO_CHARS:
                del memo[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; KeyError for an id that the file doesn't rank."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, path: str, pattern: str = PATTERN, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``with_ids`` also ``ids`` (binary).

    The decoded bytes come from the ids alone.  A null or empty text has no ids; a
    null id stays null; repeated rows give repeated results; an empty table gives
    an empty result; other columns of ``docs``, whatever their names, are not read.
    No shuffle: each row is encoded where it is scanned.  The tables sent out grow
    with the vocabulary, not with the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(path))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches):
        codec = _codec(shared, pattern)
        for b in rows_of(batches, ROWS):
            ids = codec.encode(t or "" for t in b.column(1).to_pylist())
            made = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *made] + [pa.array(ids, pa.binary())] * with_ids, schema.names)

    return src.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row with ``ids`` (binary, as ``encode_texts`` makes them): ``doc_id, text``; bytes that are no UTF-8 become U+FFFD, null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(build(path))
    schema = T.StructType([T.StructField("doc_id", rows.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        codec = _codec(shared, PATTERN)
        for b in batches:
            texts = [None if x is None else codec.decode(x).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema.names)

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)

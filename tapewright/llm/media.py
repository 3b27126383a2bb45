"""Media columns with content-defined chunks.

A text's bytes become an 8-bit mono wave file.  The file is cut where a rolling
gear hash of the last 32 bytes has its top bits zero, so equal passages give equal
chunks wherever they stand.  Writing lists the ordered digests of every file and
counts them over the corpus: a chunk that is named once is stored in its file's
row, all others are aggregated by digest into a table with one copy of each.
Reading rebuilds each distinct media file once, from its ordered list and the
stored chunks; every chunk and every file is verified against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rows_of, written

UNIT = 64
RATE = 8000
#: Chunks have at least LEAST and at most MOST bytes; between them one position in 2**BITS is a cut.
LEAST, BITS, MOST = 1024, 12, 16_384
#: Digests that a task remembers; beyond that it forgets them and may send a chunk to the aggregation again.
REMEMBERED = 200_000

#: A set of repeated digests of up to so many (7 bytes of each) is broadcast.
BROADCAST_DIGESTS = 500_000
#: Rows of one text that meet their result in one task, and how many texts may have more (their share grows with the table beyond).
PART_ROWS, HOT_FILES = 256, 100_000

GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "big") for i in range(256)], np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded with 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def encode_wave(samples: bytes) -> bytes:
    """A wave file of unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def decode_wave(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(media):
        n = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a wave file without samples")


def cuts(data: bytes, *, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted terms
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, start, i = [], 0, 0
    marks = marks.tolist()
    while n - start > least:
        while i < len(marks) and marks[i] < start + least:
            i += 1
        end = min(marks[i] if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def feature(samples: bytes) -> str:
    """Exact statistics of the samples: sum, sum of squares, extremes and changes."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    return f"sum={int(x.sum())};squares={int((x * x).sum())};min={int(x.min())};max={int(x.max())};changes={int((x[1:] != x[:-1]).sum())}"


class Packs(NamedTuple):
    """The stored form: ``files`` with ordered digests and the chunks that no other place needs, ``chunks`` with all others."""

    files: DataFrame
    chunks: DataFrame


LIST = "doc_id {kind}, n_bytes long, media_sha256 binary, digests array<binary>"


def _split(media: bytes) -> tuple[list[bytes], list[bytes]]:
    """Chunks of ``media`` and their digests."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends], ends)]
    return parts, [hashlib.sha256(c).digest() for c in parts]


def _key(digest: bytes) -> int:
    """What ``_keys`` makes of a digest."""
    return int.from_bytes(digest[:7], "big")


def _keys(digest: str):
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


def write_packs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Packs:
    """Store the media of every row of ``docs`` in the shared folder, each chunk once.

    The digests go first: those that the corpus names once stay in their file's
    row, the bytes of all others meet by digest and one copy is stored.  A null text
    counts as empty.  Null ids and repeated rows are kept as they are.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in rows_of(batches, 256):
            sizes, shas, lists = [], [], []
            for text in b.column(1).to_pylist():
                n, samples = payload_of(text)
                media = encode_wave(samples)
                sizes.append(n), shas.append(hashlib.sha256(media).digest()), lists.append(_split(media)[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_sha256", "digests"])

    lists = written(src.mapInArrow(run, LIST.format(kind=kind)))
    named = lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(named.select(_keys("digest").alias("k")).distinct())
    # without the set every chunk meets by digest; a key that a second digest has by chance only sends one chunk more there
    known = shared.count() <= BROADCAST_DIGESTS
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(shared.toArrow().column(0).to_pylist()) if known else None)

    def files(batches):
        keys = sent.value
        for b in rows_of(batches, 256):
            sizes, shas, lists, own = [], [], [], []
            for text in b.column(1).to_pylist():
                n, samples = payload_of(text)
                media = encode_wave(samples)
                parts, digests = _split(media)
                sizes.append(n), shas.append(hashlib.sha256(media).digest()), lists.append(digests)
                own.append([None if keys is None or _key(d) in keys else c for c, d in zip(parts, digests)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_sha256", "digests", "stored"])

    def common(batches):
        keys, seen = sent.value, set()
        for b in rows_of(batches, 256):
            out = {}
            for text in b.column(1).to_pylist():
                for c, d in zip(*_split(encode_wave(payload_of(text)[1]))):
                    if d not in seen and (keys is None or _key(d) in keys):
                        seen.add(d)
                        out[d] = c
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "bytes"])

    met = src.mapInArrow(common, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    return Packs(written(src.mapInArrow(files, LIST.format(kind=kind) + ", stored array<binary>")), written(met))


def _held(packs: Packs) -> DataFrame:
    """Every stored chunk: ``digest, bytes``."""
    own = packs.files.select(F.explode(F.arrays_zip("digests", "stored")).alias("c")).where("c.stored is not null")
    return own.select(F.col("c.digests").alias("digest"), F.col("c.stored").alias("bytes")).unionByName(packs.chunks)


def chunk_index(packs: Packs) -> DataFrame:
    """Per distinct chunk: ``digest, references, copies, bytes_long``; copies: how often the packs store it, always 1."""
    references = packs.files.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("references"))
    copies = _held(packs).groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.octet_length("bytes")).cast("long").alias("bytes_long"))
    return references.join(copies, "digest")


def rebuild(packs: Packs) -> DataFrame:
    """Per distinct media file: ``media_sha256`` and what ``_read_back`` computes.

    A file whose row holds all its chunks is rebuilt there: no other row has any of
    them.  All others are ordered lists joined with the stored chunks.  Raises if a
    chunk is lost or a digest differs.
    """
    whole = ~F.exists("stored", lambda x: x.isNull())
    files = packs.files.select("media_sha256", "digests", "stored")
    parts = files.where(~whole)
    lists = written(parts.select("media_sha256", "digests", F.transform("stored", lambda x: x.isNull()).alias("away")).groupBy("media_sha256").agg(F.first("digests").alias("digests"), F.first("away").alias("away")))
    wanted = lists.select("media_sha256", F.posexplode(F.arrays_zip("digests", "away")).alias("at", "c")).where("c.away").select("media_sha256", "at", F.col("c.digests").alias("digest"))
    # a file with a chunk of its own is no copy of another, so its row comes once
    own = parts.select("media_sha256", F.posexplode(F.arrays_zip("digests", "stored")).alias("at", "c")).where("c.stored is not null").select("media_sha256", "at", F.col("c.digests").alias("digest"), F.col("c.stored").alias("bytes"))
    found = wanted.join(packs.chunks, "digest", "left").select("media_sha256", "at", "digest", "bytes").unionByName(own)
    # the chunks of one file come together, never those of more
    listed = found.groupBy("media_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "bytes"))).alias("c"))
    joined = listed.select("media_sha256", F.transform("c", lambda x: x["digest"]).alias("digests"), F.transform("c", lambda x: x["bytes"]).alias("stored"))
    return _read_back(files.where(whole)).unionByName(_read_back(joined))


def _read_back(media: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for sha, digests, stored in zip(*(c.to_pylist() for c in b.columns)):
                    by = {d: s for d, s in zip(digests, stored) if s is not None}
                    if any(d not in by for d in digests) or any(hashlib.sha256(s).digest() != d for d, s in by.items()):
                        raise ValueError("a chunk is lost or differs from its digest")
                    data = b"".join(by[d] for d in digests)
                    if hashlib.sha256(data).digest() != sha:
                        raise ValueError("a rebuilt media file differs from its digest")
                    samples = decode_wave(data)
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), feature(samples)))
                n, p, c, m, f = zip(*out) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(p, pa.string()), pa.array(c, pa.int64()), pa.array(m, pa.int64()), pa.array(f, pa.string())], ["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return media.select("media_sha256", "digests", "stored").mapInArrow(run, "media_sha256 binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    Everything but ``n_bytes`` comes from the stored form, read back and verified.
    A null or empty text is 64 zero samples; equal texts have equal values; null
    ids and repeated rows stay; an empty table gives an empty result.
    """
    packs = write_packs(docs, id_col=id_col, text_col=text_col)
    files = packs.files.select("doc_id", "n_bytes", "media_sha256")
    # the rows of a hot text meet its one result in parts; above this share of all rows there are at most HOT_FILES texts
    most = max(PART_ROWS, files.count() // HOT_FILES)
    named = files.groupBy("media_sha256").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = F.broadcast(written(named.select("media_sha256", F.ceil(F.col("n") / most).alias("parts"))))
    dealt = files.join(hot, "media_sha256", "left").withColumn("part", F.monotonically_increasing_id() % F.coalesce("parts", F.lit(1))).drop("parts")
    found = rebuild(packs).join(hot, "media_sha256", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(written(found), ["media_sha256", "part"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")

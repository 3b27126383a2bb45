import hashlib
import random
import zlib

import numpy as np

from llm_cases import ODD
from tapewright.llm import media


def test_cuts_follow_content():
    r = random.Random(1)
    data = bytes(r.choice(b"abcdefgh \n") for _ in range(200_000))
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and (sizes[:-1] >= media.LEAST).all() and 2000 < sizes.mean() < 9000
    shifted = media.cuts(b"some bytes before" + data)
    chunks = lambda d, e: {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *e], e)}
    a, b = chunks(data, ends), chunks(b"some bytes before" + data, shifted)
    assert len(a & b) > 0.9 * len(a)


def test_gear_equals_a_loop():
    data = bytes(random.Random(2).randrange(256) for _ in range(300))
    h, rolling = 0, []
    for x in data:
        h = ((h << 1) + int(media.GEAR[x])) & 0xFFFFFFFF
        rolling.append(h)
    fast = media.GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        fast[step:] = fast[step:] + (fast[:-step] << np.uint32(step))
    assert fast.tolist() == rolling


def test_wave():
    samples = bytes(range(256)) * 4
    m = media.encode_wave(samples)
    assert len(m) == 44 + 1024 and media.decode_wave(m) == samples


def expected(t):
    raw = (t or "").encode()
    p = raw + bytes(-len(raw) % 64 if raw else 64)
    m = media.encode_wave(p)
    return (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p))


def test_round_trip(make_docs):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefg ") for _ in range(40_000))
    rows = [*ODD, *[(20 + i, f"{i} " * i + passage + str(i)) for i in range(12)], (40, passage), (41, passage)]
    docs = make_docs(rows)
    got = media.media_column(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *expected(t)) for i, t in rows), key=repr)
    assert media.media_column(make_docs([])).count() == 0


def test_shared_chunks_are_stored_once_for_each_task(make_docs):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefg ") for _ in range(60_000))
    packs = media.write_packs(make_docs([(i, str(i) + passage) for i in range(9)]).coalesce(1))
    index = media.chunk_index(packs)
    s = index.agg({"references": "sum", "copies": "max"}).first()
    assert s["max(copies)"] == 1 and index.count() < s["sum(references)"] / 4


def test_chunks_are_stored_once_over_all_tasks(make_docs, monkeypatch):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefg ") for _ in range(60_000))
    rows = [*ODD, *[(20 + i, str(i) + passage) for i in range(9)], *[(40 + i, "a hot text") for i in range(9)]]
    for most in (media.BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(media, "BROADCAST_DIGESTS", most)
        docs = make_docs(rows).repartition(5)
        index = media.chunk_index(media.write_packs(docs)).collect()
        want = {}
        for _, t in rows:
            m = media.encode_wave(media.payload_of(t)[1])
            ends = media.cuts(m)
            for a, b in zip([0, *ends], ends):
                d = hashlib.sha256(m[a:b]).digest()
                want[d] = want.get(d, 0) + 1
        assert {bytes(x["digest"]): (x["references"], x["copies"]) for x in index} == {d: (n, 1) for d, n in want.items()}
        assert sorted(map(tuple, media.media_column(docs).collect()), key=repr) == sorted(((i, *expected(t)) for i, t in rows), key=repr)


def test_rows_of_a_hot_text_meet_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(media, "PART_ROWS", 3)
    rows = [(i, "the same text") for i in range(40)] + [(40, None), (41, ""), (None, "the same text"), (7, "the same text"), (42, "another")]
    got = media.media_column(make_docs(rows)).collect()
    assert sorted(map(str, (g.doc_id for g in got))) == sorted(str(i) for i, _ in rows)
    by = {t: {tuple(g)[1:] for g in got for i, u in rows if i == g.doc_id and (u or "") == t} for t in ("the same text", "", "another")}
    assert all(len(v) == 1 for v in by.values())

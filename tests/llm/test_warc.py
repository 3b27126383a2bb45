import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tapewright.llm import warc
from tapewright.llm.common import shared_dir


def page(i, html, url="http://x.example/"):
    return (i, url, html)


def roundtrip(spark, rows, **options):
    path = shared_dir(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS payload", "'b' AS digest", "'c' AS p")
    warc.write_archives(df, path, **options)
    return path, warc.read_archives(spark, path, keep_payload=True)


def test_round_trip(spark):
    big = "é" * 30_000 + "\r\n\r\nWARC/1.1\r\n" + "z" * 5000
    rows = [page(1, big), page(2, big), page(3, None), page(4, ""), page(5, "small"), page(6, "small"), page(7, big, None), page(8, "a\r\n\r\nb" * 2000, "http://y\r\nX: 1"), page(None, big), page(None, None), page(5, "small")]
    _, df = roundtrip(spark, rows, segment_bytes=1000, chunk_bytes=333)
    got = df.collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert (by[7][0]["record_type"], by[7][0]["payload"].decode(), by[7][0]["url"]) == ("response", big, None)
    assert all((by[i][0]["record_type"], by[i][0]["refers_to"], by[i][0]["payload_digest"], by[i][0]["payload_bytes"]) == ("revisit", 7, sha(big), len(big.encode())) for i in (1, 2))
    assert by[3][0]["payload_bytes"] == 0 and by[3][0]["payload_digest"] == sha("") and len(by[5]) == 2 and by[8][0]["url"] == "http://y  X: 1"
    assert sorted(r["record_type"] for r in by[None]) == ["response", "revisit"]


def test_repeated_large_rows_are_all_responses(spark):
    _, df = roundtrip(spark, [page(3, "q" * 5000)] * 3 + [page(1, "q" * 5000)], segment_bytes=700)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in df.collect()) == [(1, "revisit", 3)] + [(3, "response", None)] * 3


def test_empty(spark):
    path = shared_dir(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_segments_in_any_order_and_broken_ones(spark):
    records = warc.page_records(9, "u", b"0123456789" * 500, hashlib.sha1(b"0123456789" * 500).hexdigest(), 0, segment_bytes=1000, chunk_bytes=100, date="d")
    parsed = [(h, b) for r in records for h, b in warc.parse(r + warc.END)]
    assert len(parsed) == len(records) > 3

    def frame(keep):
        rows = []
        for h, b in keep:
            number = lambda k: int(h[k]) if k in h else None
            rows.append((h["warc-record-id"], h["warc-type"], number("page-id"), None, h.get("warc-target-uri"), None, number("warc-segment-number"), h.get("warc-segment-origin-id"), number("warc-segment-total-length"), b))
        return spark.createDataFrame(rows, warc.RECORDS)

    whole = warc.decode(warc.reassemble(frame(parsed[::-1]))).collect()
    assert len(whole) == 1 and whole[0]["payload"] == b"0123456789" * 500 and whole[0]["problem"] is None
    lost = lambda keep: warc.decode(warc.reassemble(frame(keep))).first()["problem"]
    assert lost(parsed[1:]) == "the first segment is missing"
    assert lost(parsed[:2] + parsed[3:]) == "segment numbers aren't 1 to n"
    assert lost(parsed[:-1]) == "the total length is missing"
    cut = parsed[:1] + [(parsed[1][0], parsed[1][1][:-1])] + parsed[2:]
    assert lost(cut) == "the total length differs"


def test_parse_gzip_members_and_errors():
    one = warc.record({"WARC-Type": "warcinfo"}, b"abc") + warc.END
    assert [b for _, b in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense"))
    with pytest.raises(ValueError):
        list(warc.parse(one[:-6]))
    assert warc.from_chunked(warc.to_chunked(b"x" * 1000, 7)) == b"x" * 1000
    with pytest.raises(ValueError):
        warc.from_chunked(b"5\r\nabcdefg\r\n0\r\n\r\n")


def test_wrong_digest(spark):
    r = warc.page_records(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 0, segment_bytes=1000, chunk_bytes=100, date="d")[0]
    path = shared_dir(spark)
    spark.createDataFrame([(r.decode(),)], "value string").write.option("lineSep", warc.END.decode()).text(path)
    assert warc.read_archives(spark, path).first()["problem"] == "the payload's digest differs"
    assert F is not None

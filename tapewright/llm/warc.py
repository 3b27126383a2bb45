"""WARC archives: writing with revisits and segments, and reassembly.

Writing: of records with equal payloads the one with the largest page id is the
response and the others revisit it.  Blocks over ``segment_bytes`` are cut into a
first segment and continuation records.  The archives are gzip files that Spark's
own writer commits: a record is a row and the separator of rows is the blank line
that ends a WARC record.

Reading: files are parsed by Content-Length; continuation records are grouped by
origin id, ordered by segment number and checked against the total length; then
the chunked transfer framing is decoded and the payload's digest verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION, END = b"WARC/1.1", b"\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space
#: With segments of bounded size, this bounds an archive file.
FILE_RECORDS = 2048


def record_id(page_id: object, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{copy}')}>"


def record(headers: dict[str, object], block: bytes) -> bytes:
    """A record without the blank line that ends it; None leaves a header out."""
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}".encode() for k, v in headers.items() if v is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", block])


def to_chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for at in range(0, len(payload), size) if (p := payload[at : at + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunked(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(body[at : at + n])
        at += n + 2


def page_records(page_id: object, url: str | None, payload: bytes, digest: str, copy: int, *, segment_bytes: int, chunk_bytes: int, date: str) -> list[bytes]:
    """The response record of a page, as one record or as segments."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + to_chunked(payload, chunk_bytes)
    own = record_id(page_id, digest, copy)
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{base32}", "Page-Id": page_id, "Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        return [record(head, block)]
    cuts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record(head | {"WARC-Segment-Number": 1}, cuts[0])]
    for n, cut in enumerate(cuts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, digest, f"{copy}/{n}"), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Segment-Number": n, "WARC-Segment-Origin-ID": own}
        out.append(record(more | {"WARC-Segment-Total-Length": len(block) if n == len(cuts) else None}, cut))
    return out


def revisit_record(page_id: object, url: str | None, digest: str, refers_to: object, *, date: str, copy: int = 0) -> bytes:
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    return record({"WARC-Type": "revisit", "WARC-Record-ID": record_id(page_id, digest, f"revisit/{copy}"), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{base32}", "WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Page-Id": page_id, "Refers-To-Page-Id": refers_to}, b"")


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 1000, segment_bytes: int = 16_384, chunk_bytes: int = 4096, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row of ``pages`` into gzip archives below ``path``.

    A null html is an empty payload.  Rows with equal payloads of at least
    ``least_bytes`` bytes and the largest page id (several, if the row is
    repeated) are responses, the rest revisit them; rows with a null id revisit a
    group's largest id, and are responses if no row of the group has an id.  Null
    urls leave the header out.  An empty table writes no record.  Other columns
    are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # decisions need ids and digests only; the counts combine before they are shuffled
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "url", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    revisits = narrow.join(groups.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    gone = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
    # ids spread evenly; merging by sort leaves equal rows side by side, which numbers the copies
    responses = rows.join(gone.hint("merge"), rows["page_id"].eqNullSafe(gone["p"]) & (rows["digest"] == gone["d"]), "left_anti")

    def pack(batches, revisit: bool):
        last, copy = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    key = (r["page_id"], r["digest"])
                    last, copy = key, copy + 1 if key == last else 0
                    if revisit:
                        out.append(revisit_record(r["page_id"], r["url"], r["digest"], r["refers_to"], date=date, copy=copy))
                    else:
                        out += page_records(r["page_id"], r["url"], r["payload"], r["digest"], copy, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes, date=date)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    both = responses.mapInArrow(lambda b: pack(b, False), "record binary").unionAll(revisits.mapInArrow(lambda b: pack(b, True), "record binary"))
    both.select(F.col("record").cast("string")).write.options(lineSep=END.decode(), compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzip (of one or many members) or plain."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(rest) + z.flush())
            rest = z.unused_data.lstrip(b"\0")
        content = b"".join(parts)
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = content.index(END, at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(headers["content-length"])
        block = content[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("the archive ends within a record")
        yield headers, block
        at = end + 4 + n
        while content.startswith(b"\r\n", at):
            at += 2


RECORDS = "record_id string, type string, page_id long, refers_to long, url string, digest string, segment long, origin string, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, one row each."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches):
        schema = None
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), number(h.get("page-id")), number(h.get("refers-to-page-id")), h.get("warc-target-uri"), base64.b32decode(digest).hex() if digest else None, number(h.get("warc-segment-number")), h.get("warc-segment-origin-id"), number(h.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in RECORDS.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def reassemble(records: DataFrame) -> DataFrame:
    """Whole blocks: ``record_id, page_id, url, digest, blocks, problem`` of response records.

    ``blocks`` are a record's segments in order.  ``problem`` names what is wrong
    with a segmented record: its first segment is missing, its numbers aren't
    1 to n, or the total length is absent or differs; else null.
    """
    whole = records.where((F.col("type") == "response") & F.col("segment").isNull()).select("record_id", "page_id", "url", "digest", F.array("block").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    cut = records.where(F.col("segment").isNotNull()).withColumn("key", F.coalesce("origin", "record_id"))
    first = F.col("segment") == 1
    # a record's segments come together, never more than one record's
    per = cut.groupBy("key").agg(
        F.max(F.when(first, F.col("page_id"))).alias("page_id"), F.max(F.when(first, F.col("url"))).alias("url"), F.max(F.when(first, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
    )
    numbers, length = F.transform("s", lambda x: x["segment"]), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    problem = (
        F.when(F.element_at(numbers, 1) != 1, "the first segment is missing")
        .when(numbers != F.sequence(F.lit(1).cast("long"), F.size("s").cast("long")), "segment numbers aren't 1 to n")
        .when(F.col("total").isNull(), "the total length is missing")
        .when(F.col("total") != length, "the total length differs")
    )
    joined = per.select(F.col("key").alias("record_id"), "page_id", "url", "digest", F.transform("s", lambda x: x["block"]).alias("blocks"), problem.alias("problem"))
    return whole.unionByName(joined)


def decode(blocks: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """Adds ``payload_bytes, payload_digest`` (and ``payload``) and checks the declared digest."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for r in b.select(["digest", "blocks", "problem"]).to_pylist():
                    payload, problem = None, r["problem"]
                    if problem is None:
                        try:
                            head, _, body = b"".join(r["blocks"]).partition(END)
                            payload = from_chunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                            own = hashlib.sha1(payload).hexdigest()
                            if r["digest"] not in (None, own):
                                problem = "the payload's digest differs"
                        except ValueError as e:
                            problem = f"broken framing: {e}"
                    out.append((None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), payload if keep_payload else None, problem))
                n, d, p, x = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("page_id"), b.column("url"), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(p, pa.binary()), pa.array(x, pa.string())], ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "payload", "problem"])

    return blocks.mapInArrow(run, "record_id string, page_id long, url string, payload_bytes long, payload_digest string, payload binary, problem string")


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = False) -> DataFrame:
    """Per page record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem``.

    A revisit has the length and digest of the response that it refers to; where
    the archives lack that response, ``problem`` says so.  With ``keep_payload``
    responses carry their ``payload`` as well.
    """
    records = read_records(spark, path)
    responses = decode(reassemble(records), keep_payload=keep_payload)
    own = responses.select("page_id", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem", *(["payload"] if keep_payload else []))
    targets = responses.where("problem is null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = records.where("type = 'revisit'").select("page_id", "url", "refers_to", "digest").join(targets, ["refers_to", "digest"], "left")
    missing: Column = F.when(F.col("payload_bytes").isNull(), F.lit("no response with this payload"))
    again = again.select("page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", missing.alias("problem"), *([F.lit(None).cast("binary").alias("payload")] if keep_payload else []))
    return own.unionByName(again)

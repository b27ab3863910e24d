"""WARC archives: writing with revisit records, segments and chunked framing, and reading them back.

Writing: of records with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest page id is a
response and the others are revisits that refer to it. A response's block is an HTTP message; payloads over CHUNK
bytes are sent in chunks, and blocks over SEGMENT bytes are split into a first record and continuation records.
Reading: continuation records are grouped by origin id and ordered by segment number; numbers must run from 1 without
a gap and the lengths must add up to the stated total; then chunked framing is decoded and the payload's digest
verified. Records that aren't segmented are decoded where they are read and never shuffle.

Each task writes archives of about ARCHIVE bytes into the shared folder, under names and in an order that a repeated
task makes again, by way of a temporary name; so a lost executor leaves no half-written archive to be read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir, staged, table, tidy, with_group

LEAST_REVISIT, SEGMENT, CHUNK, ARCHIVE = 100, 8192, 4096, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(chr(c) for c in range(33, 127))
PARSED = "origin string, page_id long, url string, segment int, record_type string, refers_to long, digest string, total long, block binary, payload_bytes long, payload_digest string"


def record_id(page_id: object, row: object) -> str:
    return f"<urn:x-page:{'null' if pd.isna(page_id) else int(page_id)}:{int(row)}>"


def page_of(rid: str | None) -> int | None:
    page = rid.rsplit(":", 2)[-2] if rid else "null"
    return None if page == "null" else int(page)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return dechunked(body)
    if len(body) != int(fields.get(b"content-length", len(body))):
        raise ValueError("the body isn't as long as Content-Length says")
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def records(page_id: object, row: int, url: str | None, html: str | None, digest: str, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> Iterator[bytes]:
    """The gzip members for one page: one record, or a first segment and its continuations."""
    payload, rid = (html or "").encode(), record_id(page_id, row)
    target = None if pd.isna(url) else quote(str(url), safe=PRINTABLE)
    common = [("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)], block)
        return
    if len(payload) > CHUNK:
        block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield _record([("WARC-Type", "response"), *common, *([("WARC-Segment-Number", 1)] if len(parts) > 1 else [])], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = f"{rid[:-1]}:{k}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part)


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Writes pages(page_id, url, html) as archives under the folder `to`; returns a manifest (path, records, bytes).

    A null html is an empty payload, a null url is left out, null page ids come after all others; of rows with the same
    id and payload one is the response. No rows make no archive.
    """
    pages = settled(pages.select("page_id", "url", "html"), "warc-pages")  # rows are told apart by their place, and read twice
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    rows = rows.withColumn("key", F.when(F.col("n") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat_ws(":", "digest", "row"))).drop("n")
    first = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    grouped = with_group(rows, ["key"], {"first": (F.min(first), F.min)}, ["row"]).withColumn("revisit", F.col("first.row") != F.col("row"))
    ready = grouped.select("page_id", "url", "html", "row", "digest", F.when(F.col("revisit"), F.col("first.page_id")).alias("first_page"), F.when(F.col("revisit"), F.col("first.row")).alias("first_row"), "revisit")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(to)
        context, made, out, n = TaskContext.get(), [], io.BytesIO(), 0

        def close() -> None:
            nonlocal out, n
            if n:
                path = f"{root}/part-{context.partitionId():06d}-{len(made):05d}.warc.gz"
                spare = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(spare, compression=None) as f:
                    f.write(out.getbuffer())
                store.move(spare, path)
                made.append((path, n, out.tell()))
            out, n = io.BytesIO(), 0

        store.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.itertuples(index=False):
                for member in records(r.page_id, r.row, r.url, r.html, r.digest, record_id(r.first_page, r.first_row) if r.revisit else None):
                    out.write(member)
                    n += 1
                    if out.tell() >= ARCHIVE:  # a record's segments may lie in several archives
                        close()
        close()
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    # page ids as strings, since pandas has no long with nulls
    text = ready.withColumn("page_id", F.col("page_id").cast("string")).withColumn("first_page", F.col("first_page").cast("string")).sortWithinPartitions("page_id", "row")
    return staged(text.mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield fields, block


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """Per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
                    for f, block in parse(stream):
                        kind, rid = f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"])
                        digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                        n = sha = None
                        if kind == "revisit":
                            head = dict(x.lower().split(b": ", 1) for x in block.split(b"\r\n")[1:] if b": " in x)
                            n, sha, block = int(head[b"content-length"]), digest, None
                        elif kind == "response" and segment is None:
                            block = http_payload(block)
                            n, sha = len(block), hashlib.sha256(block).hexdigest()
                            if digest and sha != digest:
                                raise ValueError(f"{rid}: its payload doesn't have its digest")
                        rows.append((rid, page_of(rid), f.get("warc-target-uri"), segment, kind, page_of(f.get("warc-refers-to")), digest, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block, n, sha))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in ("page_id", "segment", "refers_to", "total", "payload_bytes")})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if list(r.numbers) != list(range(1, len(r.numbers) + 1)):
                    raise ValueError(f"{r.origin}: segments {list(r.numbers)[:20]}")
                block = b"".join(r.blocks)
                if len(block) != r.total:
                    raise ValueError(f"{r.origin}: {len(block)} bytes, not {r.total}")
                payload = http_payload(block)
                sha = hashlib.sha256(payload).hexdigest()
                if r.digest and sha != r.digest:
                    raise ValueError(f"{r.origin}: its payload doesn't have its digest")
                rows.append((page_of(r.origin), r.url, len(payload), sha, "response", None, payload))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    result = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(where).select("content")
    parsed = staged(files.mapInPandas(read, PARSED), "warc-records")
    told = parsed.filter("record_type = 'revisit'").select("digest").distinct().join(parsed.filter("record_type = 'response'").select("digest").distinct(), "digest", "left_anti")
    if lost := told.limit(3).collect():
        raise ValueError(f"no response has the payload of the revisits with {[r['digest'] for r in lost]}")
    whole = parsed.filter("segment is null").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("block").alias("payload"))
    parts = parsed.filter("segment is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.max("url").alias("url"))
    parts = parts.select("origin", F.col("s.segment").alias("numbers"), F.col("s.block").alias("blocks"), "digest", "total", "url")
    return whole.unionByName(parts.mapInPandas(join, result))


@tidy
def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages(page_id, url, html) into the shared folder and reads the archives back."""
    spark = pages.sparkSession
    to = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if write_archives(pages, to).isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_archives(spark, to)


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM q
"""

"""WARC archives with revisit records.

An archive is a run of gzip members, one record each.  ``write_archives`` turns
rows into archives of response records.  ``deduplicate`` resolves revisits: the
records' headers alone are shuffled by payload digest, each record learns the
original that it repeats, and every archive is rewritten in one sequential pass:
originals keep their payload, repeats become revisit records with fresh headers
that refer to the original.  ``read_archives`` reads records back.

A null payload counts as empty; a null key is written as such and sorts after
all others when the original is chosen (ties of digest and key go to the record
that comes first by archive and offset).  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OnceFile, arrow_schema, open_input, scratch, slices, staged, strings, table, text_of

HEADERS = "archive string, at long, length long, key long, uri string, digest string, payload_bytes long"
RECORDS = "key long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed capture time: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{key}/{digest}')}>"


def one_line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def response(key: int | None, uri: str | None, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record({"WARC-Type": "response", "WARC-Record-ID": record_id("response", key, digest), "WARC-Date": DATE, "WARC-Target-URI": one_line(uri or ""), "WARC-Payload-Digest": f"sha1:{digest}", "X-Key": "" if key is None else str(key), "Content-Type": "application/http; msgtype=response"}, http + payload)


def revisit(key: int | None, uri: str | None, digest: str, payload_bytes: int, to_key: int | None, to_uri: str | None) -> bytes:
    headers = {"WARC-Type": "revisit", "WARC-Record-ID": record_id("revisit", key, digest), "WARC-Date": DATE, "WARC-Target-URI": one_line(uri or ""), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", to_key, digest), "WARC-Refers-To-Target-URI": one_line(to_uri or ""), "WARC-Refers-To-Date": DATE, "X-Key": "" if key is None else str(key), "X-Refers-To-Key": "" if to_key is None else str(to_key), "X-Payload-Length": str(payload_bytes), "Content-Type": "application/http; msgtype=response"}
    return record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an inflated record; ValueError where it is damaged."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def records_of(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record, read in one sequential pass."""
    with open_input(path) as f:
        data, at = b"", 0
        while True:
            if not data:
                data = f.read(chunk)
                if not data:
                    return
            inflate, start, out = zlib.decompressobj(31), at, []
            while True:
                out.append(inflate.decompress(data))
                if inflate.eof:
                    at += len(data) - len(inflate.unused_data)
                    data = inflate.unused_data
                    break
                at += len(data)
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{path} ends inside a record")
            yield start, at - start, *parse(b"".join(out))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (key, uri, payload string) rows as archives, one per task; returns a header row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = arrow_schema(HEADERS), None
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"  # rows name the file of their own attempt
        for batch in slices(batches):
            got = []
            if out is None:
                out = OnceFile(path)
            for key, uri, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                payload = text.encode()
                digest = payload_digest(payload)
                data = response(key, uri, payload, digest)
                got.append((path, out.size, len(data), key, uri, digest, len(payload)))
                out.write(data)
            yield _batch(got, schema)
        if out is not None:
            out.commit()

    return staged(rows.mapInArrow(write, HEADERS), "warc-headers")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to (key) and refers_uri to the headers of records that repeat an earlier payload.

    The originals, one per digest, are pre-aggregated before the shuffle and
    written out, so that the join back can be split where a digest is frequent.
    """
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "archive", "at", "uri"))
    originals = staged(headers.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(first.alias("o")), "warc-originals")
    o = originals.select("digest", F.col("o.key").alias("o_key"), F.col("o.archive").alias("o_archive"), F.col("o.at").alias("o_at"), F.col("o.uri").alias("o_uri"))
    repeats = (F.col("payload_bytes") >= min_bytes) & F.col("o_at").isNotNull() & ((F.col("archive") != F.col("o_archive")) | (F.col("at") != F.col("o_at")))
    joined = headers.join(o, "digest", "left")
    return joined.select(*headers.columns, repeats.alias("repeats"), F.when(repeats, F.col("o_key")).alias("refers_to"), F.when(repeats, F.col("o_uri")).alias("refers_uri"))


def deduplicate(headers: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Rewrite the archives that ``headers`` describes with revisit records; returns (archive, records)."""
    decided = resolve(headers, min_bytes).select("archive", "at", "length", "key", "uri", "digest", "payload_bytes", "repeats", "refers_to", "refers_uri")
    n = max(1, headers.select("archive").distinct().count())
    ordered = decided.repartition(n, "archive").sortWithinPartitions("archive", "at")  # as many as archives: rows are short, their work isn't
    ddl = "archive string, records long"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, source, now, out, n = arrow_schema(ddl), None, None, None, 0

        def close() -> pa.RecordBatch:
            out.commit()
            return _batch([(out_path, n)], schema)

        for batch in batches:
            for x in batch.to_pylist():
                if x["archive"] != now:
                    if out is not None:
                        yield close()
                        source.close()
                    now, n = x["archive"], 0
                    source, out_path = open_input(now), f"{folder}/{now.rsplit('/', 1)[-1]}"
                    out = OnceFile(out_path)
                if x["repeats"]:
                    out.write(revisit(x["key"], x["uri"], x["digest"], x["payload_bytes"], x["refers_to"], x["refers_uri"]))
                else:
                    source.seek(x["at"])
                    out.write(source.read(x["length"]))
                n += 1
        if out is not None:
            yield close()
            source.close()

    return staged(ordered.mapInArrow(rewrite, ddl), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (column archive): digests of responses are computed from their payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(RECORDS)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for _, _, h, block in records_of(path):
                    key, kind = int(h["X-Key"]) if h["X-Key"] else None, h["WARC-Type"]
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = payload_digest(payload)
                        if h["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        rows.append((key, h["WARC-Target-URI"], len(payload), digest, kind, None))
                    else:
                        rows.append((key, h["WARC-Target-URI"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(h["X-Refers-To-Key"]) if h["X-Refers-To-Key"] else None))
                    if len(rows) >= 4096:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(read, RECORDS)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, read back from the deduplicated archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", text_of("html").alias("html"))
    headers = write_archives(pages, scratch(spark, "warc"))
    archives = deduplicate(headers, scratch(spark, "warc-dedup"))
    return read_archives(archives).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: five bits at a time from the hexadecimal SHA-1.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(encode(html)) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(hex, 1 + CAST(i // 8 AS INTEGER) * 10, 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM b GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f USING (payload_digest, payload_bytes)
"""

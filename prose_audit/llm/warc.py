"""WARC archives: written as gzipped records, read back, assembled into one nested row per capture.

Every page becomes a transaction of three records: a request, a response or revisit, and metadata. Request
and metadata name the response or revisit in WARC-Concurrent-To; the assembly joins them on that id. Of
pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id is the
response and the others revisit it.

Defined cases: a null html is the empty payload; a null url is written as the empty target and read as
null; rows without page_id are responses only if all their copies have none; rows that share the smallest
page_id of a payload are all responses; a request or metadata record whose response is missing gives no
capture, a response without them has nulls there; of several metadata records of a capture the one with the
smallest record id counts; an empty table gives archives without records. Other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, file_system, map_batches, new_folder, stored, write_file

#: A new archive begins when one has this many bytes.
ARCHIVE_BYTES = 128 << 20
#: Fixed values of the format, version 1.1: profile of revisits to equal payloads, and the record date.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6f1c9d3e-6f39-4a54-9d1e-2f0a8f5f7d10")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value: line ends in it would end the header, so they are percent-encoded and stay so."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields.items(), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def transaction(row: dict, name: str) -> bytes:
    """Request, response or revisit, and metadata of a page."""
    payload, url = (row["html"] or "").encode(), one_line(row["url"] or "")
    request, response, metadata = (f"<urn:uuid:{uuid.uuid5(NAMES, f'{name}/{kind}')}>" for kind in ("request", "response", "metadata"))
    target = {"WARC-Target-URI": url} if row["url"] is not None else {}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    shared = target | {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    about = {"page": row["page_id"]}
    if row["revisit"]:
        refers = {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Date": DATE}
        if row["first_url"] is not None:
            refers["WARC-Refers-To-Target-URI"] = one_line(row["first_url"])
        body = record("revisit", response, shared | refers, http)
        about["refers-to-page"] = row["first_id"]
    else:
        body = record("response", response, shared, http + payload)
    asked = record("request", request, target | {"Content-Type": "application/http; msgtype=request", "WARC-Concurrent-To": response}, f"GET {url} HTTP/1.1\r\n\r\n".encode())
    lines = "".join(f"{k}: {v}\r\n" for k, v in about.items() if v is not None).encode()
    return asked + body + record("metadata", metadata, target | {"Content-Type": "application/warc-fields", "WARC-Concurrent-To": response}, lines)


def write_warc(pages: DataFrame, *, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of ``pages(page_id, url, html)``; returns the stored manifest (path, n_pages).

    Rows come to a task in another order when it runs again, so every attempt writes archives of its own
    names; the manifest, which Spark commits once for each task, names those that count.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    text = F.coalesce("html", F.lit(""))
    own = own.withColumn("digest", F.sha1(text.cast("binary"))).withColumn("big", F.octet_length(text) >= min_revisit_bytes)
    # one row per repeated payload, combined before the shuffle; stored, so that the join splits the pages of a hot payload
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    least = own.filter("big").groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = own.join(stored(least, "payloads"), "digest", "left")
    revisit = F.coalesce(F.col("big") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False))
    rows = joined.select("page_id", "url", "html", revisit.alias("revisit"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    out = arrow_schema(spark, "path string, n_pages long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}"
        source = (row for batch in batches for row in batch.to_pylist())
        n = 0

        def archive(first: dict) -> Iterator[bytes]:
            nonlocal n
            size, row = 0, first
            while row is not None:
                chunk = transaction(row, f"{row['page_id']}/{part}/{n}")
                n += 1
                size += len(chunk)
                yield chunk
                row = next(source, None) if size < ARCHIVE_BYTES else None

        k = 0
        while (row := next(source, None)) is not None:
            path, before = f"{folder}/part-{part:05d}-{k:04d}-{attempt}.warc.gz", n
            write_file(path, archive(row), attempt)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n - before], pa.int64())], schema=out)

    manifest = f"{folder}/manifest"
    map_batches(rows, run, "path string, n_pages long", rows=500).write.parquet(manifest)
    return spark.read.schema("path string, n_pages long").parquet(manifest)


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked whole."""
    data = source.read(chunk)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else source.read(chunk)
            if not data and not unpack.eof:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)
        data = data or source.read(chunk)


def split_fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values; a name that comes again keeps its first value."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, target string, digest string, http_length long, "
    "payload_bytes long, payload_digest string, page_id long, refers_to long, payload binary"
)


def read_record(raw: bytes, with_payload: bool) -> dict:
    """What a record's headers and block say. Digest and length of a response are of the payload read."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = split_fields(head.partition(b"\r\n")[2])
    block = block[: int(fields.get("content-length", 0))]
    out = dict.fromkeys(x.split()[0] for x in RECORD_SCHEMA.split(", "))
    out |= {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "target": fields.get("warc-target-uri")}
    out["digest"] = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if out["type"] in ("response", "revisit") and "http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = split_fields(http).get("content-length", "")
        out["http_length"] = int(length) if length.isdigit() else None
        if out["type"] == "response":
            out |= {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload if with_payload else None}
    elif out["type"] == "metadata":
        about = split_fields(block)
        out |= {k: int(about[n]) for k, n in (("page_id", "page"), ("refers_to", "refers-to-page")) if n in about}
    return out


def read_warc(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives that ``manifest(path, ...)`` names, one task for some archives."""
    spark = manifest.sparkSession
    out = arrow_schema(spark, RECORD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = file_system(path)
                rows: list[dict] = []
                held = 0
                with system.open_input_stream(name, compression=None) as source:
                    for raw in members(source):
                        rows.append(read_record(raw, with_payload))
                        held += len(raw) if with_payload else 1
                        if len(rows) >= 2000 or held > 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: page_id, url, and the nested request, response and metadata.

    The joins are merge joins by hint: records read from archives have no size that a planner could know.
    """
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id",
        F.col("target").alias("url"),
        F.struct("type", "record_id", "digest", "http_length", "payload_bytes", "payload_digest", "payload").alias("response"),
    )

    def joined(kind: str, *columns: str) -> DataFrame:
        own = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", *columns)).alias(kind)).hint("merge")

    both = main.join(joined("request", "target"), "record_id", "left").join(joined("metadata", "page_id", "refers_to"), "record_id", "left")
    return both.select(F.col("metadata.page_id").alias("page_id"), "url", "request", "response", "metadata")


def captures(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url and the ids of the transaction's records."""
    rows = assemble(stored(read_warc(write_warc(pages, min_revisit_bytes=min_revisit_bytes)), "warc-records"))
    return rows.select(
        "page_id",
        F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
        "url",
        F.col("request.record_id").alias("request_id"),
        F.col("response.record_id").alias("response_id"),
        F.col("metadata.record_id").alias("metadata_id"),
    )

"""WARC archives of pages, with repeated payloads as revisit records.

Only headers (id, URL, digest, size) are shuffled by payload digest: of equal payloads the page with the largest page_id
is the response and the others become revisits that refer to it. The verdicts go back to the pages by page_id, to
those pages only that may have one, so no payload that many pages share gathers in one task. Each task writes its rows to an archive of its own: a warcinfo record, then one
gzip member a record, with fresh record ids, dates and digests. Reading goes through all archives, and joins the
revisits to the responses they refer to.

Payloads are the html in UTF-8; digests are bare upper-case base32 SHA-1, and sizes those of the full payload also for
revisits. Defined results: a null html is an empty payload, which is a payload like any other; payloads smaller than
``min_bytes`` are all responses; a row with a null page_id is always a response, and no response for others; rows with
equal page_id and payload, if it is the largest id, are responses each, with record ids of their own, and revisits refer
to the first; an empty table gives no archive and no row. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_counted, make_dirs, materialise, maybe_in, open_read, open_write, quoted, scratch_path, shuffle_partitions, table, task_file

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, number: int = 0) -> str:
    """The same for each attempt to write a page; ``number`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' + (f':{number}' if number else ''))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"".join((VERSION, head.encode(), f"Content-Length: {len(block)}\r\n\r\n".encode(), block, b"\r\n\r\n"))


def target(page_id, url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page_id}"


def info_record(date: str) -> bytes:
    fields = b"software: pagespine\r\nformat: WARC File Format 1.1\r\n"
    return record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, fields)


def page_record(page_id, url: str | None, payload: bytes, digest: str, winner, winner_url: str | None, date: str, number: int = 0) -> bytes:
    """A response record, or a revisit of page ``winner``'s if that is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    headers = {"WARC-Type": "response" if winner is None else "revisit", "WARC-Record-ID": record_id(page_id, digest, number), "WARC-Date": date, "WARC-Target-URI": target(page_id, url), "WARC-Payload-Digest": f"sha1:{digest}"}
    if page_id is not None:
        headers["WARC-Page-ID"] = str(page_id)
    if winner is None:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        headers |= {"WARC-Refers-To": record_id(winner, digest), "WARC-Refers-To-Target-URI": target(winner, winner_url), "WARC-Refers-To-Date": date, "WARC-Profile": REVISIT_PROFILE}
        block = http + b"\r\n"
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}"}
    return record(headers, block)


def read_archive(f):
    """(headers, block) of each record of an uncompressed stream; damaged records raise."""
    while line := f.readline():
        if line != VERSION:
            raise ValueError(f"not a record's first line: {line[:40]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size or f.read(4) != b"\r\n\r\n":
            raise ValueError("truncated record")
        digest = headers.get("warc-block-digest")
        if digest and digest != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"damaged block of {headers.get('warc-record-id')}")
        yield headers, block


def resolve(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex), winner and winner_url (the page that this one revisits, null for a
    response), twin (whether another row has this page_id and payload).

    Only rows that may be revisits or twins are joined with their verdicts; the others stay where they are.
    """
    body = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit(b"")).alias("payload"))
    body = body.withColumn("sha1", F.sha1("payload"))
    able = body.filter(F.col("page_id").isNotNull() & (F.length("payload") >= min_bytes))
    heads = materialise(able.groupBy("page_id", "sha1").agg(F.max("url").alias("url"), F.count(F.lit(1)).alias("times")), "warc-headers")
    largest = heads.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = join_counted(heads.select("page_id", "sha1"), largest, "sha1", "n").filter("page_id < w.page_id").select("page_id", "sha1", F.col("w.page_id").alias("winner"), F.col("w.url").alias("winner_url"))
    twins = heads.filter("times > 1").select("page_id", "sha1", F.lit(True).alias("twin"))
    verdicts = materialise(revisits.join(twins, ["page_id", "sha1"], "full_outer").withColumnsRenamed({"page_id": "__id", "sha1": "__sha1"}), "warc-verdicts")
    marked = maybe_in(body, "xxhash64(page_id, sha1)", verdicts, "xxhash64(__id, __sha1)", "may")
    held = marked.filter("may").join(verdicts, (F.col("page_id") == F.col("__id")) & (F.col("sha1") == F.col("__sha1")), "left")
    columns = ["page_id", "url", "payload", "sha1"]
    none = [F.lit(None).cast(verdicts.schema[c].dataType).alias(c) for c in ("winner", "winner_url", "twin")]
    return marked.filter("NOT may").select(*columns, *none).unionByName(held.select(*columns, "winner", "winner_url", "twin"))


def write_archives(resolved: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes one archive a task; returns the manifest (path, n_records) of the attempts that succeeded.

    ``date`` is that of all records, by default the time of the call. Repeated rows are dealt and sorted by page_id, so
    that they come one after the other and are numbered as they come; the others are written where they are.
    """
    spark = resolved.sparkSession
    make_dirs(folder)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        out = path = last = None
        n = number = 0
        for batch in batches:
            for page_id, url, payload, sha1, winner, winner_url, twin in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = task_file(folder, ".warc.gz")
                    out = open_write(path)
                    out.write(gzip.compress(info_record(date)))
                number = number + 1 if twin and (page_id, sha1) == last else 0
                last = (page_id, sha1)
                packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                whole = page_record(page_id, url, payload, digest, winner, winner_url, date, number if page_id is not None else uuid.uuid4().int)
                out.write(packed.compress(whole) + packed.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    rows = resolved.select("page_id", "url", "payload", "sha1", "winner", "winner_url", "twin")
    dealt = rows.filter("twin").repartition(shuffle_partitions(spark), "page_id").sortWithinPartitions("page_id", "sha1")
    made = rows.filter("twin IS NULL").unionByName(dealt).mapInArrow(write, "path string, n_records long")
    return materialise(made, "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record: page_id, url, record_type, record_id, refers_to_id, payload_digest, payload (null: revisit).

    Each archive is one task's, which holds one record at a time.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_read(path) as raw:
                    rows, size = [], 0
                    for headers, block in read_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if body is not None and base32_sha1(body) != digest:
                            raise ValueError(f"{path}: payload of {headers['warc-record-id']} doesn't have its digest")
                        page = headers.get("warc-page-id")
                        rows.append((None if page is None else int(page), headers["warc-target-uri"], kind, headers["warc-record-id"], headers.get("warc-refers-to"), digest, body))
                        size += len(block)
                        if size > 8 << 20 or len(rows) == 4096:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "record_id", "refers_to_id", "payload_digest", "payload"])

    n = manifest.count()
    schema = f"page_id {id_type}, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload binary"
    return manifest.select("path").repartition(max(1, n)).mapInArrow(read, schema)


def follow(records: DataFrame) -> DataFrame:
    """Joins each revisit to the response it refers to: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    heads = records.select("page_id", "url", "record_type", "record_id", "refers_to_id", "payload_digest", F.length("payload").cast("long").alias("own_bytes"))
    heads = materialise(heads, "warc-heads")
    revisits, none = heads.filter("record_type = 'revisit'"), F.lit(None).cast(heads.schema["page_id"].dataType)
    counted = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    responses = heads.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("full_bytes")).join(counted, "refers_to_id", "right")
    followed = join_counted(revisits, responses, "refers_to_id", "n").select("page_id", "url", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return heads.filter("record_type = 'response'").select("page_id", "url", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", none.alias("refers_to")).unionByName(followed)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(resolve(table(spark, sf_dir, "pages")), scratch_path(spark, "archives"))
    return follow(read_archives(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

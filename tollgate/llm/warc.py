"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. Each task writes one shard: it regenerates every
header and digest, puts each record into a gzip member of its own, and starts the next
file once the compressed size passes ``roll_bytes``. Files are written under temporary
names; the manifest of the committed tasks gives the final names, and a last step
renames. The same pages give the same archives, byte for byte.

Among records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest
page_id is the response and the others revisit it. Only (page_id, digest) pairs are
joined to find them; the pages themselves are shuffled once, together with those
decisions, and merged while they are written.

Defined cases: a null html is an empty payload; a null page_id sorts first and counts as
smaller than any other; of repeated rows with the same page_id and payload the first is
the response and the rest revisit it; a null url is an empty target; an empty table
gives no archive; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import store

REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
TASK_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
SPACE_OF_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
BREAKS = re.compile(r"[\x00-\x1f\x7f]")

MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_NAMES, f'{page_id}/{digest}/{again}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None, again: int) -> bytes:
    """One WARC record: a response with the payload, or a revisit (``refers_to`` is a tuple) without it."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, again)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {BREAKS.sub('', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.insert(3, f"X-Page-Id: {page_id}")
    if revisit:
        head.insert(4, f"WARC-Profile: {PROFILE}")
        head.insert(4, f"WARC-Refers-To: {record_id(refers_to[0], digest)}")
        if refers_to[0] is not None:
            head.insert(4, f"X-Refers-To-Page: {refers_to[0]}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, target) for every page whose payload occurs more than once and is long enough."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    small = pages.where(F.octet_length("html") >= REVISIT_BYTES).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"))
    groups = small.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    return small.join(store.written(groups, "warc-groups"), "digest").distinct()


def write(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Write all pages as WARC files below ``root``; returns the manifest of the files."""
    spark = pages.sparkSession
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    total = held.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    decided = decisions(held).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "target", F.lit(0).alias("kind"))
    rows = held.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("target"), F.lit(1).alias("kind"))

    def task(batches):
        shard = TaskContext.get().partitionId()
        seq, out, address, records, size = 0, None, "", 0, 0
        at, targets, seen = None, {}, {}

        def closed():
            nonlocal out, seq, records, size
            out.close()
            values = [[shard], [seq], [address], [f"pages-{shard:06d}-{seq:05d}.warc.gz"], [records], [size]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            out, seq, records, size = None, seq + 1, 0, 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                page = row["page_id"]
                if (page,) != at:
                    at, targets, seen = (page,), {}, {}
                if row["kind"] == 0:
                    targets[row["digest"]] = row["target"]
                    continue
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).hexdigest()
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                refers = None
                if digest in targets and (targets[digest] != page or again):
                    refers = (targets[digest],)
                if out is None:
                    address = store.temporary(root, f"shard-{shard:06d}-{seq:05d}")
                    out = store.create(address)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, row["url"], payload, digest, refers, again)) + packer.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    merged = rows.unionByName(decided).repartitionByRange(int(shards), "page_id").sortWithinPartitions("page_id", "kind", "url", "html")
    manifest = store.written(merged.mapInArrow(task, MANIFEST), "warc-manifest")

    def commit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store.move(row["temporary"], f"{root}/{row['name']}")
            yield batch

    return store.written(manifest.mapInArrow(commit, MANIFEST), "warc-manifest")


def members(file) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one after the other."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = file.read(READ_BYTES)
            if not data:
                break
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, with the digest of the block checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if "sha1:" + hashlib.sha1(block).hexdigest() != headers["warc-block-digest"]:
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the archives."""
    files = manifest.select("name").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "name")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def task(batches):
        rows = []
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.reopen(f"{root}/{name}") as file:
                    for data in members(file):
                        headers, block = parse(data)
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(headers["x-payload-length"])
                        if kind == "response" and (size != len(block) or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"damaged payload {headers['warc-record-id']}")
                        rows.append((number(headers.get("x-page-id")), size, digest, kind, number(headers.get("x-refers-to-page"))))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(task, RECORD)


SQL = """
WITH bodies AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS r,
         max(page_id) OVER (PARTITION BY payload_digest) AS target
  FROM bodies)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND r > 1 THEN target END AS refers_to
FROM ranked
"""

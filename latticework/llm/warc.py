"""WARC archives: a writer with one gzip member per record, and a splittable reader.

A reading task gets a byte range of a file. It looks for gzip's magic bytes, takes a candidate for a member only if its first bytes inflate to a WARC
header, and then follows the members one after the other. It owns the records that begin inside its range and reads past its end to finish the last.
So a file of any size is read by many tasks and every record exactly once.
Archives lie in a folder that all executors share and pyarrow's file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: Repeated digests that are handed to all tasks: 60 bytes each.
SMALL_DIGESTS = 50_000
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
_MORE = 1 << 18

RECORD_SCHEMA = (
    "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, digest_agrees boolean, "
    "file string, at long, payload binary"
)


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of rows with equal payloads of at least ``least`` bytes, those without the largest page_id refer to it.

    Digests are counted without payloads, per task first. Up to ``SMALL_DIGESTS`` repeated digests go to all tasks; of more, a table of their bits does, and only the rows
    that it lets through are joined by digest, whose hot keys Spark splits. Other payloads, small ones above all, are never shuffled.
    """
    rows = shared.picked(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    seen = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = shared.written(seen.filter("n > 1").select("digest", "first"), "warc-digests")
    count = seen.count()

    def referred(joined: DataFrame) -> DataFrame:
        other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least)
        return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))

    if count <= SMALL_DIGESTS:
        return referred(rows.join(F.broadcast(seen), "digest", "left"))
    bits = 1 << min(26, (16 * count).bit_length())  # 8 MB at most
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    words = seen.groupBy(F.floor(spot / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits"))
    marked = rows.withColumn("word", F.floor(spot / 64)).join(F.broadcast(words), "word", "left")
    maybe = (F.length("payload") >= least) & (F.coalesce(F.getbit("bits", (spot % 64).cast("int")), F.lit(0)) == 1)
    marked = marked.withColumn("maybe", maybe).drop("word", "bits")
    alone = marked.filter("not maybe").withColumn("first", F.lit(None).cast("long"))
    twice = marked.filter("maybe").join(seen, "digest", "left")
    return referred(alone.unionByName(twice))


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row of (page_id, url, payload, digest, refers_to); returns the manifest (file, bytes, records) of the finished files.

    Each task writes files under names of its own and names them only when they are closed. A task that is tried again writes new ones, so files that
    no manifest names are left-overs of lost tasks. The manifest is a written table: the archives are written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(posixpath.join(base, name), compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(*row)) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    made = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return shared.written(shared.mapped(made, run, "file string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from an offset on, read as needed: those of one range and of the record that goes on after it."""

    def __init__(self, stream, size: int, start: int, end: int):
        self.stream, self.size, self.base = stream, size, start
        stream.seek(start)
        self.data = bytearray(stream.read(min(size, end + len(MAGIC) - 1) - start))

    def more(self) -> bool:
        got = self.stream.read(_MORE)
        self.data += got
        return bool(got)

    def find(self, at: int, end: int) -> int:
        """The first candidate at or after ``at`` that begins before ``end``, or -1."""
        spot = self.data.find(MAGIC, at - self.base, end - self.base + len(MAGIC) - 1)
        return -1 if spot < 0 else spot + self.base

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated member at ``at`` and where it ends; None if no WARC record begins here."""
        inflater, out, spot, step, checked = zlib.decompressobj(31), bytearray(), at - self.base, 512, False
        while not inflater.eof:
            if spot >= len(self.data) and not self.more():
                return None
            try:
                piece = bytes(memoryview(self.data)[spot : spot + step])
                out += inflater.decompress(piece)
            except zlib.error:
                return None
            spot, step = spot + len(piece), _MORE
            if not checked and len(out) >= 7:
                if not out.startswith(b"WARC/1."):
                    return None
                checked = True
        return (bytes(out), self.base + spot - len(inflater.unused_data)) if checked else None


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def parse(data: bytes) -> tuple:
    """(page_id, type, target_uri, refers_to, payload_bytes, payload_digest, digest_agrees, payload) of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        agrees, payload = None, None
    else:
        size, own = len(payload), hashlib.sha1(payload).hexdigest()
        digest, agrees = own, own == digest
    return _number(fields.get("WARC-Record-ID")), fields["WARC-Type"], fields.get("WARC-Target-URI"), _number(fields.get("WARC-Refers-To")), size, digest, agrees, payload


def records_in(system, path: str, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members of a file that begin in [start, end)."""
    with system.open_input_file(path) as stream:
        window, at = _Window(stream, size, start, end), start
        while at < end and (at := window.find(at, end)) >= 0:
            if (got := window.member(at)) is None:
                at += 1
            else:
                yield at, got[0]
                at = got[1]


def read_archives(manifest: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the files of a manifest (file, bytes), as RECORD_SCHEMA; payload only if asked for, and null for revisits.

    payload_bytes and payload_digest are of the full payload: measured for responses (digest_agrees: as the record says), as recorded for revisits.
    Memory is that of one range and the largest record. An empty file or manifest gives no rows.
    """
    spark = manifest.sparkSession
    ranges = manifest.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, ranges.count())
    ranges = ranges.repartition(min(tasks, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), "file", "start")
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
            + [("payload_digest", pa.string()), ("digest_agrees", pa.bool_()), ("file", pa.string()), ("at", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for file, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                system, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                for at, data in records_in(system, path, size, start, min(size, start + split_bytes)):
                    *fields, payload = parse(data)
                    rows.append((*fields, file, at, payload if payloads else None))
                    held += len(data) if payloads else 200
                    if held > _MORE * 16:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return shared.mapped(ranges, run, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes an archive of pages (page_id, url, html) in the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null url leaves out the target; null page_ids stay null (and refer to the largest id of their payload).
    Rows with the largest page_id of a payload are all responses, also when repeated. An empty table gives no rows. Other columns are ignored.
    """
    manifest = write_archives(deduplicated(pages), shared.path(spark, "warc"))
    return read_archives(manifest, False, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """The round trip of all pages through archives."""
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
 f AS (SELECT digest, max(page_id) AS first, count(*) AS n FROM p WHERE strlen(html) >= {REVISIT_BYTES} GROUP BY digest),
 j AS (SELECT p.*, CASE WHEN f.n > 1 AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to FROM p LEFT JOIN f ON p.digest = f.digest)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""

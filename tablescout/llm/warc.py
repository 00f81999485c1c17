"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import if_small, in_batches, query, settle, table

#: Payloads from this size on are stored once.
LEAST_BYTES = 1000
#: Bytes of records in a frame, and of frames in a bundle.
FRAME_BYTES, BUNDLE_BYTES = 256_000, 4_000_000
#: Pages, or bundles, handed to Python at once.
PAGES, BUNDLES = 200, 4
#: End of the names of archive files.
SUFFIX = ".warc.zst"
#: The archive's time stamp; pages have none.
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: the skippable frame of the seek table, and the end of the file.
TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLE = (
    "bundle string, archive binary, "
    "records array<struct<record_id:string,frame:int,offset:long,length:long>>"
)
RECORD = (
    "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
    "record_id string, bundle string, frame int, offset long, payload binary"
)


def record_name(page_id: str | None, digest: str) -> str:
    """Identifier of a record, which records that refer to it can name as well."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> tuple[str, bytes]:
    name = record_name(page_id, digest)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        # A line break would end the field.
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    body = HTTP + payload if refers_to is None else HTTP
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return name, b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


class Bundler:
    """Frames of whole records, followed by the seek table."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.records: list[tuple[str, int, int, int]] = []
        self.open, self.open_bytes, self.bytes = [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.close_frame()
        self.records.append((name, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)

    def close_frame(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.bytes += len(frame)
        self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        if self.open:
            self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, FOOTER_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)), entries, footer])


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, size and unpacked size of each frame, from the end of the archive."""
    number, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != FOOTER_MAGIC or flags & 0x80:
        raise ValueError("the archive has no seek table of the expected kind")
    entries = archive[len(archive) - 9 - 8 * number : len(archive) - 9]
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", entries):
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(archive: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, size = place
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=size)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields and body of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    body = end + 4
    stop = body + int(fields["Content-Length"])
    return fields, data[body:stop], stop + 4


def read_record(archive: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its frame and its offset in it; no other frame is unpacked."""
    fields, body, _ = parse(read_frame(archive, seek_table(archive)[frame]), offset)
    return fields, body


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and ``refers_to``, the page whose payload is the same and stored instead.

    Digests are grouped before anything wide moves, and only digests that occur twice are joined back; payloads stay
    where they are read while those digests are few enough to go to all tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    key = {"digest": F.sha1("payload"), "check": F.xxhash64("payload"), "n_bytes": F.octet_length("payload")}
    rows = rows.withColumns(key)
    groups = rows.where(F.col("n_bytes") >= LEAST_BYTES).groupBy(*key).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = settle(groups.where("n > 1").drop("n"))
    rows = rows.join(if_small(groups), list(key), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def write_bundles(pages: DataFrame) -> DataFrame:
    """A row for each bundle: its name, the archive, and where each record stands, by frame and offset within it.

    Of pages with equal payloads of at least 1000 bytes, the one with the largest page_id is stored and the others
    become revisit records. Each task packs its records into frames of at most 256,000 bytes, or one record, and
    frames into bundles of about four megabytes, so a task holds one bundle.
    """
    rows = with_originals(pages)
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = rows.select(text("page_id"), text("url"), "payload", "digest", text("refers_to"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, number, part = Bundler(), 0, 0

        def row(done: Bundler) -> pa.RecordBatch:
            archive = done.finish()
            where = [dict(zip(("record_id", "frame", "offset", "length"), r)) for r in done.records]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            columns = [pa.array([f"{part:06d}-{number:06d}"]), pa.array([archive], pa.binary()), pa.array([where], kind)]
            return pa.RecordBatch.from_arrays(columns, ["bundle", "archive", "records"])

        for batch in batches:
            page_ids, urls, payloads, digests, others, parts = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                part = parts[i].as_py()
                bundler.add(*record(page_ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), others[i].as_py()))
                if bundler.bytes >= BUNDLE_BYTES:
                    yield row(bundler)
                    bundler, number = Bundler(), number + 1
        if bundler.records:
            yield row(bundler)

    return rows.mapInArrow(in_batches(run, PAGES), BUNDLE)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of all bundles, frame by frame; a payload that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, archive in zip(batch.column(0), batch.column(1)):
                data = archive.as_py()
                for frame, place in enumerate(seek_table(data)):
                    yield records(bundle.as_py(), frame, read_frame(data, place))

    def records(bundle: str, frame: int, data: bytes) -> pa.RecordBatch:
        rows, at = [], 0
        while at < len(data):
            start = at
            fields, body, at = parse(data, at)
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
            payload = body[len(HTTP) :]
            if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                raise ValueError(f"record {fields['WARC-Record-ID']} of bundle {bundle} is damaged")
            url = fields.get("WARC-Target-URI")
            rows.append(
                {
                    "page_id": fields.get("X-Page-ID"),
                    "url": None if url is None else re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url),
                    "payload_bytes": size,
                    "payload_digest": digest,
                    "record_type": fields["WARC-Type"],
                    "refers_to": fields.get("X-Refers-To-Page-ID"),
                    "record_id": fields["WARC-Record-ID"],
                    "bundle": bundle,
                    "frame": frame,
                    "offset": start,
                    "payload": payload if with_payload and fields["WARC-Type"] == "response" else None,
                }
            )
        kinds = {"payload_bytes": pa.int64(), "frame": pa.int32(), "offset": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return bundles.select("bundle", "archive").mapInArrow(in_batches(run, BUNDLES), RECORD)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each archive as the file ``<bundle>.warc.zst`` of a folder that all executors reach: bundle, path, bytes.

    Files are written under a name of their own and renamed when whole, so a task that is done again leaves one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for bundle, archive in zip(batch.column(0).to_pylist(), batch.column(1)):
                path, part = f"{root}/{bundle}{SUFFIX}", f"{root}/.{bundle}-{uuid.uuid4().hex}"
                data = archive.as_buffer()
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([path]), pa.array([data.size], pa.int64())], ["bundle", "path", "bytes"])

    return settle(bundles.select("bundle", "archive").mapInArrow(in_batches(run, BUNDLES), "bundle string, path string, bytes long"))


def import_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder as rows for :func:`read_bundles`: bundle, archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, rf"{re.escape(SUFFIX)}$", "").alias("bundle"), F.col("content").alias("archive"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive all pages and read the archives back: one row for each record.

    The bundles are written to the shared checkpoint folder as a table with the archive's bytes and the places of its
    records, and read from there. Null pages have an empty payload. Rows repeated with one page_id are as many
    records; if they have the largest page_id of their payload, all of them are stored. A payload whose pages have no
    identifier at all is stored each time, as nothing could be referred to. Further columns are not looked at.
    """
    kind = pages.schema["page_id"].dataType
    found = read_bundles(settle(write_bundles(pages)), with_payload=False).drop("payload")
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""


@query("op8_warc", WARC_SQL)
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = archive_pages(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

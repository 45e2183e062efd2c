"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Archives are series of gzip members, one record each. A read task gets a byte range of one
file. It scans for the gzip magic, takes a place for a member only if its header bits are legal
and its first inflated bytes are a WARC version line, and then owns every record that starts
inside its range, reading past the end for the last one. So any archive splits, with no index.

Write tasks put their files under new names into the target folder; the driver's commit writes
the list of files that count. A lost executor leaves at most files that no list names. Files
are reached by the URI of the folder (local or mounted, S3, GCS or HDFS).

Text must be valid Unicode: the magic's second byte never starts a UTF-8 sequence, so a page's own
bytes cannot hold a member. Of archives with raw gzip payloads stored uncompressed, nested members
could be taken for records where a range starts inside one.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
WRITE_SCHEMA = "page_id string, uri string, refers_to string, payload_digest string, payload binary"
ID_FORM = re.compile(r"<urn:page:(.*)>")
#: Each write adds a list of its files of its own; only listed files are read.
LISTS = "_files-"


def opened(uri: str):
    """File system and path of a folder's URI."""
    from pyarrow import fs

    if "://" not in uri:
        uri = re.sub(r"^file:", "", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str) -> str:
    """White space and control characters as percent escapes, so that a URI stays on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record_bytes(page_id: str | None, uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with its HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean_uri(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """Fields of one uncompressed record; the digest of a response is that of the payload read."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    revisit = fields["WARC-Type"] == "revisit"

    def page(name: str) -> str | None:
        found = ID_FORM.fullmatch(fields.get(name, ""))
        return found[1] or None if found else fields.get(name)

    digest = stated if revisit else payload_digest(payload)
    if not revisit and stated and digest != stated:
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload digest {digest}, stated {stated}")
    return {
        "page_id": page("WARC-Record-ID"),
        "uri": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload_digest": digest,
        "payload_bytes": int(length[1]) if revisit and length else len(payload),
        "payload": None if revisit else payload,
    }


def member(file, at: int, piece: int = 1 << 14) -> tuple[bytes, int] | None:
    """The record of the gzip member at `at` and the place after it; None if there is no valid one."""
    file.seek(at)
    got = file.read(piece)
    if len(got) < 18 or got[:3] != MAGIC or got[3] & 0xE0:
        return None
    inflate, out, used, checked = zlib.decompressobj(wbits=31), bytearray(), 0, False
    while got:
        try:
            out += inflate.decompress(got)
        except zlib.error:
            return None
        used += len(got)
        if not checked and len(out) >= len(VERSION):
            if not out.startswith(VERSION):
                return None
            checked = True
        if inflate.eof:
            return (bytes(out), at + used - len(inflate.unused_data)) if checked else None
        got = file.read(piece)
    return None


def records(file, start: int, end: int, piece: int = 1 << 18):
    """Records whose members start in [start, end)."""
    at, aligned = start, False
    while at < end:
        if not aligned:
            file.seek(at)
            seen = file.read(piece)
            found = seen.find(MAGIC)
            if found < 0:
                if len(seen) < piece:
                    return
                at += piece - len(MAGIC) + 1
                continue
            at += found
            if at >= end:
                return
        got = member(file, at)
        aligned = got is not None
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", 16 << 20))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self):
        from pyarrow import fs

        system, folder = opened(self.folder)
        infos = system.get_file_info(fs.FileSelector(folder))
        files, lists = [], sorted(i.path for i in infos if i.base_name.startswith(LISTS))
        for listed in lists:
            with system.open_input_file(listed) as file:
                files += [(f"{folder}/{name}", size) for name, size in json.loads(file.read())]
        if not lists:
            # A folder that some other program wrote.
            files = [(i.path, i.size) for i in infos if re.search(r"\.warc(\.gz)?$", i.path)]
        ranges = [Range(p, at, min(at + self.split, n), n) for p, n in files for at in range(0, n, self.split)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        schema = WarcSource.arrow_schema()
        if not partition.size:
            return
        system, _ = opened(self.folder)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for record in records(io.BufferedReader(file, 1 << 20), partition.start, partition.end):
                row = parsed(record)
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Written(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows of WRITE_SCHEMA to archives of about `file_bytes` each.

    A write counts once its list stands. Appending adds a list; overwriting takes the earlier ones away after that.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.folder = options["path"]
        self.overwrite = overwrite
        self.level = int(options.get("level", 6))
        self.roll = int(options.get("file_bytes", 256 << 20))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator):
        system, folder = opened(self.folder)
        files, out, size = [], None, 0
        for batch in iterator:
            for page, uri, refers, digest, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                        files[-1][1] = size
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = system.open_output_stream(f"{folder}/{files[-1][0]}", compression=None), 0
                gzip = zlib.compressobj(self.level, wbits=31)
                data = gzip.compress(record_bytes(page, uri, refers, digest, payload or b"", self.date)) + gzip.flush()
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages):
        system, folder = opened(self.folder)
        files = sorted(f for m in messages if m is not None for f in m.files)
        from pyarrow import fs

        earlier = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith(LISTS)]
        with system.open_output_stream(f"{folder}/{LISTS}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        for path in earlier if self.overwrite else []:
            system.delete_file(path)

    def abort(self, messages):
        system, folder = opened(self.folder)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    """Format `warc`. Options: path, split_bytes, payload (read); level, file_bytes, date (write)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    @staticmethod
    def arrow_schema() -> pa.Schema:
        text = ["page_id", "uri", "record_type", "refers_to", "payload_digest"]
        return pa.schema([*((n, pa.string()) for n in text), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite) -> WarcWriter:
        system, folder = opened(self.options["path"])
        system.create_dir(folder, recursive=True)
        return WarcWriter(dict(self.options), overwrite)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, mode: str = "append") -> None:
    """Write one record per row, after those that stand at `path` or, with mode `overwrite`, in their place: of equal payloads of at least `least` bytes the smallest id is the response.

    A null html is an empty payload. Repeated rows of the smallest id are all responses; rows
    without an id come after all others and refer to the smallest id there is; if there is none
    they are responses. The first ids come from a combining aggregate over digests, and only digests
    that more than one row holds are joined, as a skewed join that Spark splits.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("own"),
        F.col(url_col).cast("string").alias("uri"),
        payload.cast("binary").alias("payload"),
        F.sha1(payload).alias("hexed"),
    )
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("hexed").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    shared = shared.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("hexed", "first")
    joined = rows.join(shared, "hexed", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("own").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    narrow = joined.select(F.col("own").cast("string").alias("page_id"), "uri", refers.alias("refers_to"), base32("hexed").alias("payload_digest"), "payload")
    pages.sparkSession.dataSource.register(WarcSource)
    narrow.write.format("warc").mode(mode).save(path)


def base32(hexed: str):
    """Base32 of a hex digest of a multiple of 20 bits: five hex digits make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(at):
        number = F.conv(F.substring(F.col(hexed), at, 5), 16, 10).cast("int")
        return [F.substr(letters, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[c for at in range(1, 40, 5) for c in four(at)])


def read_pages(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("split_bytes", split_bytes).load(path)


def oracle(least: int = 0) -> str:
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first, count(*) AS copies FROM p WHERE n >= {least} GROUP BY h)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, (5 * g + 1)::INTEGER, 5))::BIGINT >> s) & 31)::INTEGER, 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)"""

"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP with two stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdxj`, a line with offset and length for each record. The reader never inflates or
copies the ZIP: it takes the end of the source, follows the end-of-central-directory record (and the
ZIP64 locator, where sizes or offsets don't fit 32 bits) to the central directory, finds each stored
member's data behind its local header, and reads single records by range.

Archives are files in the shared folder, written and read by the workers through pyarrow's file systems
(local or mounted folders, HDFS, object stores); between the two only their names travel. A task names
its files at random, so an attempt that is lost leaves files that nobody refers to. The reader asks for
ranges: the end, the directory, the index, and then windows of some records each; no archive is in
memory as a whole.

Edge cases: null html = empty payload; null url = empty target; control characters in a url are
percent-encoded; payloads under `least` bytes are never revisits; rows that repeat the smallest
page_id of a payload are responses too; a null page_id counts as the largest; pages of any size get
an archive of their own if need be; a damaged record raises an error; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.llm.common import shared_dir, slices, written
from gabbro.tables import table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
U32 = 0xFFFFFFFF


# ---------------------------------------------------------------- ZIP


class BytesSource:
    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class FileSource:
    """Ranges of a file, by its path or URI."""

    def __init__(self, path: str):
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri(os.path.abspath(path)))
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        self.bytes_read = 0

    def read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


class Window:
    """Ranges of a source, in windows: records that lie side by side take one request."""

    def __init__(self, source, window: int = 1 << 20):
        self.source, self.window, self.size = source, window, source.size
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.source.read(at, min(max(n, self.window), self.size - at))
        return self.held[at - self.at : at - self.at + n]


def write_file(path: str, data: bytes) -> None:
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri(os.path.abspath(path)))
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(data)


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; ZIP64 records where a value needs them, or everywhere if zip64."""
    out, central = [], []
    at = 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or max(n, at) >= U32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = U32 if big else n
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        central.append(
            struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, U32 if big else at)
            + raw + extra
        )
        out += [local, data]
        at += len(local) + n
    directory = b"".join(central)
    out.append(directory)
    n, size = len(members), len(directory)
    if zip64 or at >= U32 or size >= U32 or n >= 0xFFFF:
        out.append(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, at))
        out.append(struct.pack("<IIQI", 0x07064B50, 0, at + size, 1))
        out.append(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, U32, U32, 0))
    else:
        out.append(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, at, 0))
    return b"".join(out)


class ZipReader:
    """Directory of a ZIP behind any source with read(at, n) and size."""

    def __init__(self, source):
        self.source = source
        self.members: dict[str, tuple[int, int, int]] = {}  # name -> (local header, size, crc)
        self.begins: dict[str, int] = {}
        n, size, at = self._end()
        raw = source.read(at, size)
        p = 0
        for _ in range(n):
            head = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, p)
            if head[0] != 0x02014B50:
                raise ValueError("not a central directory record")
            method, crc, packed, full, names, extras, comment, local = head[4], head[7], head[8], head[9], head[10], head[11], head[12], head[16]
            name = raw[p + 46 : p + 46 + names].decode()
            extra = raw[p + 46 + names : p + 46 + names + extras]
            full, packed, local = self._wide(extra, full, packed, local)
            if method or packed != full:
                raise ValueError(f"{name} is compressed; only stored members can be read by range")
            self.members[name] = (local, full, crc)
            p += 46 + names + extras + comment

    def _end(self) -> tuple[int, int, int]:
        """(members, bytes of the central directory, where it begins)."""
        tail = min(self.source.size, 22 + 0xFFFF)
        raw, base = self.source.read(self.source.size - tail, tail), self.source.size - tail
        at = raw.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", raw, at)
        if n == 0xFFFF or U32 in (size, start):
            mark, _, wide, _ = struct.unpack("<IIQI", self.source.read(base + at - 20, 20))
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            head = struct.unpack("<IQHHIIQQQQ", self.source.read(wide, 56))
            if head[0] != 0x06064B50:
                raise ValueError("no ZIP64 end of central directory")
            n, size, start = head[7:10]
        return n, size, start

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int, int]:
        p, values = 0, [full, packed, local]
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                q = p + 4
                for k, v in enumerate(values):
                    if v == U32:
                        values[k] = struct.unpack_from("<Q", extra, q)[0]
                        q += 8
            p += 4 + n
        return tuple(values)

    def begin(self, name: str) -> int:
        """Where a member's data begin: its local header has lengths of its own. Looked up once."""
        if name in self.begins:
            return self.begins[name]
        local = self.members[name][0]
        head = struct.unpack("<IHHHHHIIIHH", self.source.read(local, 30))
        if head[0] != 0x04034B50:
            raise ValueError("no local header")
        self.begins[name] = local + 30 + head[9] + head[10]
        return self.begins[name]

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        size = self.members[name][1]
        if n is None:
            n = size - at
        if at < 0 or at + n > size:
            raise ValueError("range outside the member")
        return self.source.read(self.begin(name) + at, n)


# ---------------------------------------------------------------- WARC


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; names in lower case."""

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def pack(pages: DataFrame, archive_bytes: int = 16 << 20, level: int = 4) -> DataFrame:
    """Pages (page_id, url, html, digest, refers_to, revisit) as archives of about archive_bytes of
    payload each, written to the shared folder: (records, path)."""
    folder = f"{shared_dir(pages.sparkSession)}/gabbro/warc-{uuid.uuid4().hex}"

    def close(lines: list[bytes], parts: list[bytes]) -> pa.RecordBatch:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        write_file(path, zip_stored([(DATA, b"".join(parts)), (INDEX, b"".join(lines))]))
        return pa.RecordBatch.from_arrays([pa.array([len(lines)], pa.int64()), pa.array([path])], names=["records", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, parts, at, held = [], [], 0, 0
        for whole in batches:
            for b in slices(whole, "html", archive_bytes):
                for page, url, html, digest, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
                    payload = (html or "").encode()
                    if lines and held + len(payload) > archive_bytes:
                        yield close(lines, parts)
                        lines, parts, at, held = [], [], 0, 0
                    raw = gzip.compress(record(page, url or "", payload, digest, refers_to, revisit), level, mtime=0)
                    lines.append(json.dumps({"page": page, "offset": at, "length": len(raw)}).encode() + b"\n")
                    parts.append(raw)
                    at += len(raw)
                    held += len(payload)
        if lines:
            yield close(lines, parts)

    return written(pages.mapInArrow(run, "records long, path string"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of archives (path): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits). Digests of responses are made from the payload."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def rows(reader: ZipReader) -> Iterator[tuple]:
        for line in reader.read(INDEX).splitlines():
            entry = json.loads(line)
            warc, http, payload = parse(gzip.decompress(reader.read(DATA, entry["offset"], entry["length"])))
            digest, n = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
            again = warc["warc-type"] == "revisit"
            if not again and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"record {warc['warc-record-id']} is damaged")
            yield number(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], number(warc.get("warc-refers-to")), n, digest, None if again else payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                source = FileSource(path)
                held, n = [], 0
                for row in rows(ZipReader(Window(source))):
                    held.append(row)
                    n += row[4]
                    if n > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                source.close()

    # names are small, archives are not: a few of them for each task
    return archives.select("path").repartition(max(1, min(100_000, -(-archives.count() // 2)))).mapInArrow(run, schema)


def dedup(pages: DataFrame, least: int = 100) -> DataFrame:
    """Adds digest, refers_to and revisit. Payload groups are counted from digests alone (partial
    sums before the shuffle); only groups of two or more are written and joined, and Spark broadcasts
    them if their files are under its threshold or else splits skewed digests."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"),
    )
    groups = own.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    groups = written(groups.filter("copies > 1 and first_id is not null").select(F.col("digest").alias("of"), "first_id"), "warc-groups")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    # short payloads can't be in a group: the digest of one is never that of a longer text
    joined = own.join(groups, F.col("digest") == F.col("of"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = pack(dedup(table(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc_zip": op10_warc_zip}
ORACLE_SQL = {
    "op10_warc_zip": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
}

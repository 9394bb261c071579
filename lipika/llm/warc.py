"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction.

A package holds stored (not deflated) members: archive/data.warc.gz, whose records are gzip members of their own, and indexes/index.cdxj, a line a record with offset and length within the archive. The reader parses the end-of-central-directory record (ZIP64 too), the central directory and the local headers, then reads only the index and the byte ranges of the wanted records.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, END64_LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder or file that all executors share: file, hdfs, s3, gs; a plain path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# --- writing ---------------------------------------------------------------------------------------------------------


class StoredZip:
    """Streams stored members to a file that need not seek: a member's sizes and checksum follow its data, in a descriptor with 8-byte sizes."""

    def __init__(self, sink: BinaryIO, zip64: bool = False):
        self.sink, self.at, self.members, self.zip64 = sink, 0, [], zip64

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.at += len(b)

    def begin(self, name: str) -> None:
        n = name.encode()
        self.open = [n, self.at, 0, 0]
        # bit 3: sizes are in the data descriptor; the ZIP64 extra field says that these are 8 bytes each
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, b: bytes) -> None:
        self.open[2] = zlib.crc32(b, self.open[2])
        self.open[3] += len(b)
        self._put(b)

    def end(self) -> None:
        _, _, crc, size = self.open
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append(tuple(self.open))

    def close(self) -> None:
        start = self.at
        for n, at, crc, size in self.members:
            big = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            s, a = (FULL32, FULL32) if big else (size, at)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, s, s, len(n), len(extra), 0, 0, 0, 0, a) + n + extra)
        size, count = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or count >= FULL16:
            at64 = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
            self._put(END64_LOCATOR + struct.pack("<IQI", 0, at64, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, count, count, size, start, 0))


def record(page: int, url: str, kind: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the response's HTTP header, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    clean = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n", 1, mtime=0)


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of equal payloads of least_bytes or more, the largest page_id is the response. The digests are summed to one row each before they meet the pages, and only digests seen twice or more do; that table is written, so Spark can broadcast it while small and else split a digest that holds many pages.
    Null html is the empty payload. Rows with equal page_id and payload all are the response. A null page_id is a response, or a revisit where an equal payload has an id. Other columns are left out.
    """
    p = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    seen = p.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "first")
    firsts = stash(seen, "payloads")
    joined = p.join(firsts, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_archives(marked: DataFrame, folder: str, package_bytes: int = 256 << 20, zip64: bool = False) -> DataFrame:
    """One ZIP package or more from each partition, of about package_bytes at most; returns (path, records), written and read again.

    A package is written under a name of its own task attempt and only the names that the committed result lists count, so a task that runs twice adds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        zf = None

        def finish():
            zf.end()
            zf.begin(INDEX)
            for line in lines:
                zf.write(line)
            zf.end()
            zf.close()
            zf.sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64())], names=["path", "records"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page, url, payload, size, digest, refers = row
                if zf is None:
                    name, lines = f"{uuid.uuid4().hex}.wacz", []
                    zf = StoredZip(fs.open_output_stream(f"{base}/{name}"), zip64)
                    zf.begin(ARCHIVE)
                got = record(page, url, "response" if refers is None else "revisit", payload, digest, refers)
                about = {"url": url, "offset": zf.open[3], "length": len(got), "filename": ARCHIVE.rpartition("/")[2]}
                lines.append(f"page:{page} 19700101000000 {json.dumps(about)}\n".encode())
                zf.write(got)
                if zf.open[3] >= package_bytes:
                    yield finish()
                    zf = None
        if zf is not None:
            yield finish()

    cols = marked.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return stash(cols.mapInArrow(run, "path string, records long"), "packages")


# --- reading ---------------------------------------------------------------------------------------------------------


class ZipReader:
    """Members of a ZIP file by range reads: read_at(offset, length) of any random-access file is all it needs."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - (22 + FULL16))
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):  # not a signature within the comment
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        end = tail_at + at
        locator = read_at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == END64_LOCATOR:
            record64 = read_at(int.from_bytes(locator[8:16], "little"), 56)
            if record64[:4] != END64:
                raise ValueError("bad ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", record64[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}  # name: method, size, local header
        directory, p = read_at(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL:
                raise ValueError("bad central directory")
            flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
            packed, plain, n, x, c = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
            at = int.from_bytes(directory[p + 42 : p + 46], "little")
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + n : p + 46 + n + x], 0
            while q + 4 <= len(extra):
                tag, size_ = struct.unpack("<HH", extra[q : q + 4])
                if tag == 1:  # ZIP64: just the values that are full in the entry, in this order
                    wide = iter(struct.unpack(f"<{size_ // 8}Q", extra[q + 4 : q + 4 + size_ // 8 * 8]))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    at = next(wide) if at == FULL32 else at
                q += 4 + size_
            self.members[name] = (method, packed, at)
            p += 46 + n + x + c

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        method, size, at = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read_at(at, 30)
        if head[:4] != LOCAL:
            raise ValueError("bad local header")
        n, x = struct.unpack("<HH", head[26:30])
        return at + 30 + n + x, size


def _headers(text: bytes) -> dict[str, str]:
    """Names in lower case and values of the lines after the first."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("utf-8", "replace").split("\r\n")[1:])}


def _hex_digest(value: str) -> str | None:
    """A sha1 digest in hex; writers give it in base 32 (in either case) or in hex. Other algorithms: null."""
    import base64

    kind, _, x = value.partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(x.upper()).hex() if len(x) == 32 else x.lower()


def _page(value: str | None) -> int | None:
    """The page id of <urn:page:7>; null of any other record id."""
    import re

    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(packed: bytes) -> dict:
    """WARC type, page, payload and headers of one record, a gzip member or plain. What is no HTTP message has its whole block as payload; a record without a target has no url, one with an id of another kind no page_id, one without a payload digest none."""
    data = gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    body = rest[: int(warc["content-length"])]
    payload, size = body, len(body)
    if warc.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
        # a revisit has the response's head without its payload
        size = int(_headers(http).get("content-length", len(payload))) if warc["warc-type"] == "revisit" else len(payload)
    return {
        "page_id": _page(warc.get("warc-record-id")),
        "url": warc["warc-target-uri"].strip("<>") if "warc-target-uri" in warc else None,
        "record_type": warc["warc-type"],
        "payload_bytes": size,
        "payload_digest": _hex_digest(warc["warc-payload-digest"]) if "warc-payload-digest" in warc else None,
        "refers_to": _page(warc.get("warc-refers-to")),
        "payload": None if warc["warc-type"] == "revisit" else payload,
    }


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def index_entries(lines: bytes) -> list[tuple[str, int, int]]:
    """(file name, offset, length) of each line of a CDXJ index: a sort key, a timestamp and JSON, or JSON alone; numbers may be strings, and header lines (!) and lines without an offset are left out."""
    out = []
    for line in lines.splitlines():
        at = line.find(b"{")
        if at < 0 or line.startswith(b"!"):
            continue
        e = json.loads(line[at:])
        if "offset" in e and "length" in e:
            out.append((e.get("filename", "").rpartition("/")[2], int(e["offset"]), int(e["length"])))
    return out


def record_lengths(read_at, start: int, size: int, chunk: int = 1 << 20) -> Iterator[int]:
    """Lengths of the gzip members that follow each other in a range, found by inflating them; what has no index must be walked."""
    at, held = 0, b""
    while at < size or held:
        d, used = zlib.decompressobj(31), 0
        while not d.eof:
            if not held:
                if at >= size:
                    raise ValueError("a record is cut off")
                held = read_at(start + at, min(chunk, size - at))
                at += len(held)
            d.decompress(held)
            used += len(held) - len(d.unused_data)
            held = d.unused_data
        yield used


def package_entries(f_read, size: int) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record of a package: of its stored .warc.gz members, by the stored indexes (.cdxj, .cdxj.gz, .cdx.gz) that name them, else by walking the member."""
    zf = ZipReader(f_read, size)
    base = {n.rpartition("/")[2]: zf.locate(n) for n, (method, _, _) in zf.members.items() if n.endswith(".warc.gz") and not method}
    if not base:
        raise ValueError("no stored .warc.gz member")
    found: dict[str, set[tuple[int, int]]] = {}
    for n, (method, _, _) in zf.members.items():
        if n.endswith((".cdxj", ".cdxj.gz", ".cdx.gz")) and not method:
            where, length = zf.locate(n)
            lines = f_read(where, length)
            for name, o, k in index_entries(gzip.decompress(lines) if n.endswith(".gz") else lines):
                # an index of one archive may leave its name out
                found.setdefault(name or next(iter(base)), set()).add((o, k))
    out = []
    for name, (start, length) in base.items():
        if name in found:
            out += [(start + o, k) for o, k in found[name]]
        else:
            at = start
            for k in record_lengths(f_read, start, length):
                out.append((at, k))
                at += k
    return sorted(out)


def index_of(packages: DataFrame, slice_bytes: int = 2 << 20) -> DataFrame:
    """(path, start, lengths): runs of consecutive records of each package, of about slice_bytes; start is an offset in the package's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    entries = package_entries(lambda o, n, f=f: f.read_at(n, o), f.size())
                run_at, lengths, held, end = 0, [], 0, 0
                for o, n in entries:
                    if lengths and (held >= slice_bytes or o != end):
                        rows.append((path, run_at, lengths))
                        lengths = []
                    if not lengths:
                        run_at, held = o, 0
                    lengths.append(n)
                    held, end = held + n, o + n
                if lengths:
                    rows.append((path, run_at, lengths))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """The revisits (page_id, payload_digest, refers_to) whose response is not among the records or has another digest: what a revisit's header says of its payload can only be checked there."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.where("record_type = 'revisit' and refers_to is not null").select("page_id", "payload_digest", "refers_to").join(responses, ["refers_to", "payload_digest"], "left_anti")


def read_archives(packages: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the packages (path), of whatever writer. Ranges are dealt out evenly, so that a large package is read by many tasks; a damaged record (its digest, of a response) raises."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    data = f.read_at(sum(lengths), start)
                found, p = [], 0
                for n in lengths:
                    got = parse_record(data[p : p + n])
                    if got["record_type"] == "response" and got["payload_digest"] is not None and hashlib.sha1(got["payload"]).hexdigest() != got["payload_digest"]:
                        raise ValueError(f"{path}: the payload of page {got['page_id']} does not fit its digest")
                    found.append(got if payload else got | {"payload": None})
                    p += n
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in found], k) for c, k in zip(names, kinds, strict=True)], names=names)

    ranges = stash(index_of(packages), "ranges")
    total = ranges.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # a number of tasks that follows the bytes to read: with none, Spark would merge these small rows in one task
    tasks = max(1, -(-total // packages.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return ranges.repartition(tasks).mapInArrow(run, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to ZIP packages in the shared folder and read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    packages = write_archives(mark_revisits(pages), f"{shared_dir(spark)}/lipika-packages-{uuid.uuid4().hex}")
    return read_archives(packages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

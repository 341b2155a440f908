"""WARC records in ZIP packages, written and read in place.

A package is a ZIP file whose members are stored, not deflated: the archive (a
WARC file, each record gzip'd on its own), its index (a CDXJ line a record: search
key, time, place and length in the archive) and a description. The reader parses the end
record, the ZIP64 locator and end record where there are any, and the central
directory; a stored member then is a range of the package, and a record a range
of the member, read without unpacking anything else.

Writing: digests and the first page of each payload come from a pre-aggregated
sum by digest, joined back (hot digests are split); each task then writes
packages of PACKAGE bytes at most plus one record. Reading is one package a task.

Defined results: a null html is an empty payload; of equal payloads of LEAST
bytes or more the rows with the smallest page_id are responses (all of them, if
that page_id repeats), the others revisit it; rows without a page_id revisit
too where another row has one, else are responses; repeated rows give a record
each; very long payloads are one record, of which a task holds one package's; an
empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import blobs
from brindle.llm.shared import scratch, written

#: Payloads shorter than this are never revisits; bytes of a package's archive.
LEAST, PACKAGE = 100, 16 << 20
Read = Callable[[int, int], bytes]
_EPOCH, _TIMESTAMP = "2020-01-01T00:00:00Z", "20200101000000"
_PAGES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP packages


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class ZipPackage:
    """The directory of a ZIP file, of which only ranges are read."""

    def __init__(self, read: Read, size: int) -> None:
        self.read, self.size = read, size
        tail_size = min(size, 22 + 65_535)
        tail = read(size - tail_size, tail_size)
        at = len(tail) - 22
        # The end record's comment must reach exactly to the file's end.
        while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at + 3) if at else -1
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        end = size - tail_size + at
        if entries == _FULL16 or length == _FULL32 or offset == _FULL32:
            locator = read(end - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._directory(read(offset, length), entries)}

    @staticmethod
    def _directory(data: bytes, entries: int) -> Iterator[Member]:
        at = 0
        for _ in range(entries):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, n, x, c = struct.unpack_from("<IIIHHH", data, at + 16)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n : at + 46 + n + x]
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = iter(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                    size = next(wide) if size == _FULL32 else size
                    packed = next(wide) if packed == _FULL32 else packed
                    header = next(wide) if header == _FULL32 else header
                extra = extra[4 + m :]
            yield Member(name, method, crc, packed, size, header)
            at += 46 + n + x + c

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin; its own header may hold another extra field than the directory."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no header for {name}")
        n, x = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + x

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError("outside the member")
        return self.read(self.start(name) + offset, length)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return data


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64: with the wide fields even where they are not needed."""
    out, directory = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), out.tell()
        wide = zip64 or len(data) >= _FULL32 or at >= _FULL32
        size = _FULL32 if wide else len(data)
        version = 45 if wide else 20
        near = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        far = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0x800, 0, 0, 0x5021, crc, size, size, len(raw), len(near)) + raw + near + data)
        directory.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0x800, 0, 0, 0x5021, crc, size, size, len(raw), len(far), 0, 0, 0, 0, _FULL32 if wide else at) + raw + far)
    at, listing = out.tell(), directory.getvalue()
    wide = zip64 or at >= _FULL32 or len(members) >= _FULL16
    out.write(listing)
    if wide:
        end = out.tell()
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(listing), at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    n = _FULL16 if wide else len(members)
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, _FULL32 if wide else len(listing), _FULL32 if wide else at, 0))
    return out.getvalue()


# ---------------------------------------------------------------- WARC records


def _safe(value: str) -> str:
    """A header's value: no line ends."""
    return " ".join(value.split("\r\n")).replace("\r", " ").replace("\n", " ")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_safe(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the block of a gzip'd record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    if rest[length : length + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:length]


def _labelled(digest: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")


def _bare(label: str) -> str:
    code = label.removeprefix("sha256:")
    return base64.b32decode(code + "=" * (-len(code) % 8)).hex()


def record_id(page_id: int | None) -> str:
    """The same for a page in each run, so that revisits name their original without looking it up."""
    return f"<urn:uuid:{uuid.uuid5(_PAGES, '' if page_id is None else str(page_id))}>"


def page_record(page_id: int | None, url: str | None, html: str, digest: str, revisits: int | None) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    size = str(len(payload))
    headers = [("WARC-Type", "response" if revisits is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("Page-ID", "" if page_id is None else str(page_id)), ("WARC-Date", _EPOCH), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", _labelled(digest)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if revisits is None:
        return record(headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(revisits)), ("Refers-To-Page-ID", str(revisits))]
    # A revisit keeps the HTTP headers, so the payload's length, but not the payload.
    return record(headers, http)


def _page(number: str | None) -> int | None:
    return int(number) if number else None


def read_page(raw: bytes) -> dict[str, object]:
    """What a record says of its page; a response's payload is held against its digest."""
    headers, block = parse(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = _bare(headers["warc-payload-digest"])
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    page_id, refers = _page(headers["page-id"]), _page(headers.get("refers-to-page-id"))
    if headers["warc-record-id"] != record_id(page_id) or (refers is not None and headers["warc-refers-to"] != record_id(refers)):
        raise ValueError("a record's id is not that of its page")
    return {"page_id": page_id, "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": refers}


# ---------------------------------------------------------------- the operator


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html (no nulls), digest, and revisits: the page that a row revisits, null for a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    # Only digests that repeat come back, so the other side stays small and rows are not dealt by digest unless they must.
    groups = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    joined = rows.join(groups.select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when((F.col("size") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("revisits"))


def search_key(url: str | None) -> str:
    """A URL as indexes sort it: its host's parts from the last on, a bracket, then the path; without scheme and "www."."""
    rest = (url or "").strip().lower().partition("://")
    host, slash, path = (rest[2] or rest[0]).partition("/")
    name, _, port = host.rpartition("@")[2].partition(":")
    parts = name.removeprefix("www.").split(".")
    key = ",".join(reversed(parts)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (slash + path or "/")
    return re.sub(r"\s", lambda m: "".join(f"%{b:02x}" for b in m[0].encode()), key)


def package(records: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """A package of records, each with its page_id and url for the index: CDXJ lines (key, time, JSON), sorted."""
    lines, at = [], 0
    for page_id, url, raw in records:
        about_it = {"url": url or "", "filename": ARCHIVE.rpartition("/")[2], "offset": str(at), "length": str(len(raw)), "page_id": page_id}
        lines.append(f"{search_key(url)} {_TIMESTAMP} {json.dumps(about_it)}")
        at += len(raw)
    lines.sort()
    about = json.dumps({"profile": "data-package", "records": len(records), "archive": ARCHIVE, "index": INDEX})
    return zip_stored([(ARCHIVE, b"".join(r[2] for r in records)), (INDEX, "\n".join(lines).encode()), (ABOUT, about.encode())])


def read_package(read: Read, size: int) -> Iterator[dict[str, object]]:
    """Every page of a package, in the order of its archive, each record by its own range."""
    held = ZipPackage(read, size)
    base, room = held.start(ARCHIVE), held.members[ARCHIVE].size
    entries = (json.loads(line.split(" ", 2)[2]) for line in held.whole(INDEX).decode().split("\n") if line)
    for offset, length in sorted((int(e["offset"]), int(e["length"])) for e in entries):
        if offset + length > room:
            raise ValueError("the index points outside the archive")
        yield read_page(read(base + offset, length))


def _writer(folder: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        records: list[tuple[int | None, str | None, bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, size, records
            path = f"{folder}/{part:06d}-{number:06d}.wacz"
            data = package(records)
            blobs.write(path, data)
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(records)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})
            number, size, records = number + 1, 0, []
            return row

        for batch in batches:
            for page_id, url, html, digest, revisits in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "revisits")), strict=True):
                raw = page_record(page_id, url, html, digest, revisits)
                records.append((page_id, url, raw))
                size += len(raw)
                if size >= PACKAGE:
                    yield flush()
        if records:
            yield flush()

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with blobs.Reader(path) as read:
                rows: list[dict[str, object]] = []
                for row in read_package(read, read.size):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))


def write_packages(pages: DataFrame) -> DataFrame:
    """Writes the packages; path, n_records and n_bytes of each."""
    folder = scratch(pages.sparkSession, "warc")
    return written(with_originals(pages).mapInArrow(_writer(folder), "path string, n_records long, n_bytes long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = packages.select("path").repartition(max(1, min(packages.count(), 20_000)))
    return files.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_digest(pages: DataFrame) -> DataFrame:
    return read_packages(write_packages(pages))

"""WARC archives in ZIP packages, read by byte range.

A package is a ZIP file whose members are all stored (method 0), so every byte of a member has a
fixed place in the file::

    archive/data.warc.gz      one gzip member per record
    indexes/index.cdx         a line "offset length payload-digest record-id" per record
    datapackage.json          counts

The reader opens a package through the store's file system (:func:`ranges`) and seeks in it: nothing is
loaded whole. It finds the end-of-central-directory record from the tail, follows the ZIP64 locator where
sizes or offsets overflow (or where ``zip64=True`` forced it), parses the central directory, locates
the members, loads the index and reads single records by range; nothing is extracted. It needs only
``read(offset, length)`` and the size, so any store with range reads will do; from a store that Spark
alone can open, packages come as whole values and are read by range in memory.

Packages are real files: each is one value that Spark's text writer puts out byte for byte, one per
file. The line end that the writer adds is the ZIP comment. Spark commits the files and can write
them to any store.

Records of equal payloads: the one with the largest page_id is a response, the others are revisits
that refer to it. Defined results: a null html is an empty payload; a null page_id sorts below all
others and takes part like them (if all page_ids of a payload are null, all are responses); rows that
repeat the largest page_id are responses too; an empty table gives no package and no rows; other
columns than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, skewed_left_join

#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 64 << 20
#: Most payloads with copies that are broadcast (some 50 bytes each).
BROADCAST_COPIES = 100_000
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
_ZIP_DATE = (0 << 11, (2020 - 1980) << 9 | 1 << 5 | 1)
_SPACE = uuid.UUID("6f2c1d0a-5b1e-5c7e-9b62-1f0f6f3f9a10")


# ------------------------------------------------------------------ ZIP


def build_zip(members: list[tuple[str, bytes]], comment: bytes = b"", zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP file of stored members."""
    parts, directory, at = [], [], 0
    for name, data in members:
        crc, big = zlib.crc32(data), zip64 or len(data) >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        size = 0xFFFFFFFF if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        label = name.encode()
        head = struct.pack("<4s5H3I2H", b"PK\3\4", 45 if big else 20, 0x800, 0, *_ZIP_DATE, crc, size, size, len(label), len(extra))
        parts += [head, label, extra, data]
        wide = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        directory.append(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, *_ZIP_DATE, crc, size, size, len(label), len(wide), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + label + wide)
        at += len(head) + len(label) + len(extra) + len(data)
    listed = b"".join(directory)
    parts.append(listed)
    n, end = len(members), at + len(listed)
    if zip64 or n >= 0xFFFF or end >= 0xFFFFFFFF:
        parts.append(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listed), at))
        parts.append(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        parts.append(struct.pack("<4s4H2IH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)))
    else:
        parts.append(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, len(listed), at, len(comment)))
    parts.append(comment)
    return parts


class ZipPackage:
    """Members of a ZIP file, found through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        tail_at = max(0, size - 65557)
        tail = bytes(read(tail_at, size - tail_at))
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            mark = bytes(read(tail_at + at - 20, 20))
            if mark[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            far = bytes(read(struct.unpack_from("<Q", mark, 8)[0], 56))
            if far[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", far, 32)
        listed, at = bytes(read(start, length)), 0
        #: name: (offset of the local header, length, method)
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(n):
            if listed[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", listed, at + 10)[0]
            packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", listed, at + 20)
            place = struct.unpack_from("<I", listed, at + 42)[0]
            name, extra = listed[at + 46 : at + 46 + name_n].decode(), listed[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, size_n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{size_n // 8}Q", extra, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    place = next(wide) if place == 0xFFFFFFFF else place
                extra = extra[4 + size_n :]
            self.members[name] = (place, packed, method)
            at += 46 + name_n + extra_n + comment_n

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data in the file."""
        place, length, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = bytes(self.read(place, 30))
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return place + 30 + name_n + extra_n, length


# ----------------------------------------------------------------- WARC


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, revisit: bool) -> bytes:
    """A WARC/1.1 record (not compressed): a response, or a revisit without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        plain = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            head.append(f"X-Target-URI-Base64: {base64.b64encode(url.encode()).decode()}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def build_package(records: list[tuple[bytes, str, str]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """A package of (compressed record, payload digest, record id)."""
    at, lines = 0, []
    for data, digest, rid in records:
        lines.append(f"{at} {len(data)} {digest} {rid}\n")
        at += len(data)
    about = json.dumps({"profile": "warc-zip", "records": len(records)}).encode()
    archive = b"".join(x for x, _, _ in records)
    return b"".join(build_zip([(ARCHIVE, archive), (INDEX, "".join(lines).encode()), (ABOUT, about)], comment, zip64))


def read_package(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a package, each by one range read."""
    package = ZipPackage(read, size)
    start, _ = package.locate(ARCHIVE)
    for line in bytes(read(*package.locate(INDEX))).decode().splitlines():
        offset, length = map(int, line.split(" ", 2)[:2])
        yield parse_record(zlib.decompress(read(start + offset, length), 31))


# ---------------------------------------------------------------- Spark


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``original``: the largest page_id of the same payload, null if it has no copies.

    Payloads are summed map-side. One that very many pages share is not shuffled: its pages take their
    original from a broadcast.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    held = pages.select("page_id", "url", html.alias("html"))
    held = held.withColumn("payload", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    many = held.groupBy("payload").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    return skewed_left_join(held, materialise(many, "warc-copies"), ["payload"], broadcast_rows=BROADCAST_COPIES).drop("payload")


def _pack(package_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, str, str]] = []
        size = 0

        def close() -> pa.RecordBatch:
            image = build_package(held, comment=b"\n")[:-1]  # the text writer ends it with the comment
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])

        for batch in batches:
            ids, urls, originals = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for page_id, url, html, original in zip(ids, urls, batch.column(2), originals, strict=True):
                payload = html.as_buffer().to_pybytes()
                digest, revisit = payload_digest(payload), original is not None and page_id != original
                record = build_record(page_id, url, payload, original, digest, revisit)
                held.append((_gzip(record), digest, record_id(page_id)))
                size += len(held[-1][0])
                if size >= package_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    return pack


def write_packages(pages: DataFrame, *, package_bytes: int = PACKAGE_BYTES) -> str:
    """Write all pages; returns the folder of the package files."""
    path = fresh_path(pages.sparkSession, "warc")
    held = with_originals(pages).select("page_id", "url", "html", "original")
    images = held.mapInArrow(_pack(package_bytes), "image binary")
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def ranges(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]] | None:
    """``read(offset, length)`` of a file by its URI, and what closes it; None if only Spark can open it."""
    try:
        system, place = fs.FileSystem.from_uri(path)
        file = system.open_input_file(place)
    except (pa.ArrowException, OSError):
        return None
    return lambda at, n: file.read_at(n, at), file.close


def _rows(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of READ_SCHEMA; every response's payload is checked against its digest."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    while True:
        rows = []
        for head, block in islice(records, 4096):
            kind, size = head["warc-type"], int(head["x-payload-length"])
            digest = head["warc-payload-digest"].partition(":")[2]
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if len(payload) != size or payload_digest(payload) != digest:
                    raise ValueError(f"record {head['warc-record-id']} is damaged")
            number = lambda k: int(head[k]) if head.get(k) else None  # noqa: E731, B023
            exact = head.get("x-target-uri-base64")
            url = base64.b64decode(exact).decode() if exact else head.get("warc-target-uri")
            rows.append((number("x-page-id"), url, size, digest, kind, number("x-refers-to-page")))
        if not rows:
            return
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in READ_SCHEMA.split(", ")])


def _unpack_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of packages, given as paths and lengths, by ranges of the files."""
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if length:
                read, close = ranges(path)
                yield from _rows(read_package(read, length))
                close()


def _unpack_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of packages, given as whole values."""
    for batch in batches:
        for image in batch.column(0):
            view = memoryview(image.as_buffer())
            if len(view):
                yield from _rows(read_package(lambda at, n, v=view: v[at : at + n], len(view)))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all packages in the folder; every response's payload is checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    listed = files.select("path", "length")  # the contents are not read
    first = listed.first()
    if first is not None and ranges(first["path"]):
        deal = max(1, min(listed.count(), 4 * spark.sparkContext.defaultParallelism))
        return listed.repartition(deal).mapInArrow(_unpack_files, READ_SCHEMA)
    return files.select("content").mapInArrow(_unpack_values, READ_SCHEMA)

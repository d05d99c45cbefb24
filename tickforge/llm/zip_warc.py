"""WARC records in ZIP packages: written by Spark, read back by ranges.

A package holds pairs of stored members: ``archive/data-00000.warc`` (records)
and ``indexes/data-00000.cdxj`` (one line a record: where it lies in the
member). The reader parses the end record, the ZIP64 records and the central
directory from the tail of a file, finds stored archives and their indexes,
and reads only the bytes of records; nothing is unpacked. Locations of
records are a table of their own (100 bytes a record), dealt out by blocks of
``BLOCK`` bytes, so that one large package is read by many tasks.

Spark's text writer lays the packages down, one for each partition, on any
file system it can write to and under its commit protocol. It ends every row
with a separator; ``\\r\\n\\r\\n``, which also ends a WARC record. In the other
rows those four bytes are part of the format: the data of an extra field
of a member's header, the end of an index, the comment that ends the package.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .common import BROADCAST_BYTES, slices, staged

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Records of one archive member; its index is kept in memory while it is written.
MEMBER_RECORDS = 10_000
#: Rows that a task turns into records at once.
WRITE_ROWS = 128
#: Bytes of a package whose records one group of rows reads, and most bytes of one read of several records.
BLOCK = 4 << 20
#: Bytes between two records that are read along rather than skipped.
GAP = 1 << 16
#: Copies of one payload from which it counts as hot.
HOT_COPIES = 1 << 16
#: Digests (32 bytes) and row numbers of hot payloads, about.
HOT_ROW_BYTES = 64

# Fixed values of the formats.
SEPARATOR = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL, CENTRAL, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08"
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
WIDE = 0xFFFFFFFF
#: Largest tail of a file in which the end record can lie: 22 bytes and a comment.
TAIL = 22 + 0xFFFF
#: Extra field of this writer, filled by the separator (ids under 32 are reserved).
OWN_FIELD = 0x7466


# --- writing

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record without its closing separator.

    A response holds an HTTP head and the payload; a revisit (``refers_to``) the head only.
    """
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    own = hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:sha256:{own}>", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_VISIBLE)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + SEPARATOR + block


#: Characters that a header keeps as they are; all else is percent-encoded.
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))


@dataclass
class _Member:
    name: bytes
    offset: int
    crc: int
    size: int
    flags: int
    date: int = 0x21 | (2024 - 1980) << 9


class Packer:
    """Bytes of one package as rows that the text writer ends with ``SEPARATOR`` each."""

    def __init__(self, member_records: int = MEMBER_RECORDS, wide: bool = False):
        self.limit, self.wide = member_records, wide
        self.at, self.members, self.index = 0, [], []
        self.member: _Member | None = None

    def _row(self, data: bytes) -> bytes:
        self.at += len(data) + len(SEPARATOR)
        return data

    def _head(self, m: _Member, extra: bytes) -> bytes:
        known = not m.flags & 8
        return LOCAL + struct.pack("<5H3I2H", 45, m.flags, 0, 0, m.date, m.crc if known else 0,
                                   m.size if known else 0, m.size if known else 0, len(m.name), len(extra)) + m.name + extra

    def _close(self) -> bytes:
        """The end of the open member and its index; the index takes the separator as its end."""
        m = self.member
        wide = self.wide or m.size >= WIDE
        out = DESCRIPTOR + struct.pack("<I2Q" if wide else "<I2I", m.crc, m.size, m.size)
        lines = "".join(f"{json.dumps(x, separators=(',', ':'))}\n" for x in self.index).encode()
        name = m.name.replace(b"archive/", b"indexes/").replace(b".warc", b".cdxj")
        index = _Member(name, self.at + len(out), zlib.crc32(lines + SEPARATOR), len(lines) + len(SEPARATOR), 0)
        self.members += [m, index]
        self.member, self.index = None, []
        return out + self._head(index, b"") + lines

    def add(self, data: bytes, page_id: int | None) -> Iterator[bytes]:
        if self.member is not None and len(self.index) >= self.limit:
            yield self._row(self._close())
        if self.member is None:
            name = f"archive/data-{len(self.members) // 2:05d}.warc".encode()
            self.member = _Member(name, self.at, 0, 0, 8)
            yield self._row(self._head(self.member, struct.pack("<2H", OWN_FIELD, len(SEPARATOR)) + SEPARATOR)[:-len(SEPARATOR)])
        m, length = self.member, len(data) + len(SEPARATOR)
        self.index.append({"filename": m.name.decode().rpartition("/")[2], "offset": m.size, "length": length, "page": page_id})
        m.crc, m.size = zlib.crc32(SEPARATOR, zlib.crc32(data, m.crc)), m.size + length
        yield self._row(data)

    def finish(self) -> Iterator[bytes]:
        """The last index, the central directory and the end record, whose comment the separator is."""
        if self.member is not None:
            yield self._row(self._close())
        start, rows = self.at, []
        for m in self.members:
            wide, extra = self.wide or max(m.size, m.offset) >= WIDE, b""
            if wide:
                extra = struct.pack("<2H3Q", 1, 24, m.size, m.size, m.offset)
            size, offset = (WIDE, WIDE) if wide else (m.size, m.offset)
            rows.append(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, m.flags, 0, 0, m.date, m.crc, size, size, len(m.name),
                                              len(extra), 0, 0, 0, 0, offset) + m.name + extra)
        directory, n = b"".join(rows), len(rows)
        tail = b""
        if self.wide or n >= 0xFFFF or start + len(directory) >= WIDE:
            tail = (END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, len(directory), start)
                    + LOCATOR64 + struct.pack("<IQI", 0, start + len(directory), 1))
            n, size, begin = 0xFFFF, WIDE, WIDE
        else:
            size, begin = len(directory), start
        yield self._row(directory + tail + END + struct.pack("<4H2IH", 0, 0, n, n, size, begin, len(SEPARATOR)))


def identify(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, html as binary, digest, refers_to) of all pages; null html is empty.

    ``refers_to`` is the smallest key with an equal payload of ``LEAST_REVISIT``
    bytes or more, null on rows that have that key themselves, or if all keys of
    the payload are null. Digests are counted in a partial aggregate; the rows
    of a hot payload meet its one row by a broadcast of at most rows /
    ``HOT_COPIES`` rows, all others in a shuffled join on the digest.
    """
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    d = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = staged(d.where(long).select("page_id", digest.alias("digest")).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null"), "payloads")
    hot = first.where(F.col("n") >= HOT_COPIES).select("digest", F.col("first").alias("hot"))
    rest = first.where(F.col("n") < HOT_COPIES).select("digest", F.col("first").alias("rest"))
    small = first.count() * HOT_ROW_BYTES <= BROADCAST_BYTES
    d = d.withColumn("digest", digest)
    d = d.join(F.broadcast(first.select("digest", F.col("first").alias("hot"))), "digest", "left") if small else (
        d.join(F.broadcast(hot), "digest", "left").join(rest, "digest", "left").withColumn("hot", F.coalesce("hot", "rest")))
    again = F.col("page_id").isNull() | (F.col("page_id") > F.col("hot"))
    return d.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"),
                    F.when(F.col("hot").isNotNull() & again, F.col("hot")).alias("refers_to"))


def write(records: DataFrame, path: str, member_records: int = MEMBER_RECORDS, wide: bool = False) -> None:
    """Write the rows of ``identify`` to packages under ``path``, one for each partition that has rows.

    A task holds one batch of rows and the index of one member. ``wide`` writes
    ZIP64 records also where they are not needed.
    """
    def run(batches):
        pack, empty = Packer(member_records, wide), True
        for b in slices(batches, WRITE_ROWS):
            rows: list[bytes] = []
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += pack.add(record(page, url, html, digest, refers), page)
            empty = empty and not rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["row"])
        if not empty:
            yield pa.RecordBatch.from_arrays([pa.array(list(pack.finish()), pa.binary())], names=["row"])

    ship_package(records.sparkSession)
    (records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "row binary")
     .select(F.col("row").cast("string").alias("value"))  # bytes as they are
     .write.option("lineSep", SEPARATOR.decode()).option("compression", "none").option("maxRecordsPerFile", 0).text(path))


# --- reading

@dataclass(frozen=True)
class Entry:
    """A member by the central directory."""
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def _exactly(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"package ends at {at + len(data)}, {n} bytes wanted from {at}")
    return data


def directory(f, length: int) -> list[Entry]:
    """Members of a package of ``length`` bytes that ``f`` (seek, read) gives access to."""
    tail = _exactly(f, max(0, length - TAIL), min(length, TAIL))
    base = length - len(tail)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the mark can also stand in a comment
    if at < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack_from("<H2I", tail, at + 10)
    if base + at >= 20 and (n == 0xFFFF or WIDE in (size, start)):
        locator = _exactly(f, base + at - 20, 20)
        if locator[:4] == LOCATOR64:
            end = _exactly(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, size, start = struct.unpack_from("<3Q", end, 32)
    data, found, at = _exactly(f, start, size), [], 0
    for _ in range(n):
        if data[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, _, _, crc, packed, whole, names, extras, notes = struct.unpack_from("<3H3I3H", data, at + 10)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + names].decode("utf-8", "replace")
        wide, e, stop = b"", at + 46 + names, at + 46 + names + extras
        while e + 4 <= stop:
            kind, k = struct.unpack_from("<2H", data, e)
            if kind == 1:
                wide = data[e + 4:e + 4 + k]
            e += 4 + k
        values, j = [whole, packed, header], 0
        for i, v in enumerate(values):  # only fields that are all ones stand in the wide field, in this order
            if v == WIDE and j + 8 <= len(wide):
                values[i], = struct.unpack_from("<Q", wide, j)
                j += 8
        found.append(Entry(name, method, crc, values[1], values[0], values[2]))
        at = stop + notes
    return found


def data_start(f, entry: Entry) -> int:
    """Offset of a member's bytes: its local header has extra fields of its own."""
    head = _exactly(f, entry.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no header of {entry.name}")
    return entry.header + 30 + sum(struct.unpack_from("<2H", head, 26))


_ARCHIVE = re.compile(r"\.warc(\.gz)?$")
_INDEX = re.compile(r"\.cdxj?(\.gz)?$")


def locate(f, length: int) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record, by the indexes or, without them, record by record.

    Lines of an index end in a JSON object with filename, offset and length. An
    archive member that is not stored cannot be read by ranges and is an error.
    """
    entries = [e for e in directory(f, length) if _ARCHIVE.search(e.name) or _INDEX.search(e.name)]
    starts = {}
    for e in entries:
        if _ARCHIVE.search(e.name):
            if e.method:
                raise ValueError(f"{e.name} is compressed by the package, not stored")
            starts[e.name.rpartition("/")[2]] = (data_start(f, e), e)
    told = set()
    for e in entries:
        if _INDEX.search(e.name):
            for line in _lines(f, e):
                at = line.find(b"{")
                if at < 0:
                    continue
                x = json.loads(line[at:])
                name = str(x["filename"]).rpartition("/")[2]
                if name not in starts:
                    raise ValueError(f"index {e.name} names {name}, which the package does not hold")
                told.add(name)
                yield starts[name][0] + int(x["offset"]), int(x["length"])
    for name, (start, e) in starts.items():
        if name not in told:
            yield from _walk(f, start, e)


def _lines(f, entry: Entry) -> Iterator[bytes]:
    """Lines of an index, stored or deflated, also of a gzip file in it; a piece at a time."""
    at, left, rest = data_start(f, entry), entry.packed, b""
    steps = [zlib.decompressobj(-15)] if entry.method == 8 else []
    if entry.name.endswith(".gz"):
        steps.append(zlib.decompressobj(31))
    while left:
        data = _exactly(f, at, min(left, BLOCK))
        at, left = at + len(data), left - len(data)
        for i, step in enumerate(steps):
            out, data = [], step.decompress(data) if not step.eof else b""
            out.append(data)
            while step.eof and step.unused_data and entry.name.endswith(".gz") and i == len(steps) - 1:
                more = step.unused_data  # the next gzip member
                step = steps[i] = zlib.decompressobj(31)
                out.append(step.decompress(more))
            data = b"".join(out)
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _walk(f, start: int, entry: Entry) -> Iterator[tuple[int, int]]:
    """Records of a member without an index, from head to head (from member to member where gzipped)."""
    at, end = start, start + entry.size
    while at < end:
        if entry.name.endswith(".gz"):
            step, n = zlib.decompressobj(31), 0
            while not step.eof:
                data = _exactly(f, at + n, min(end - at - n, 1 << 16))
                step.decompress(data)
                n += len(data) - len(step.unused_data)
        else:
            head = b""
            while SEPARATOR not in head:
                more = min(end - at - len(head), 1 << 13)
                if more <= 0:
                    raise ValueError("record without an end of its head")
                head += _exactly(f, at + len(head), more)
            head = head[:head.index(SEPARATOR) + 4]
            n = len(head) + int(headers(head)["content-length"]) + 4
        yield at, n
        at += n


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a record's or an HTTP head, names in lower case."""
    found = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in found if k.strip()}


def parse(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record's bytes.

    Digests of the block and of a response's payload are computed and compared.
    A revisit's are those of the payload it refers to, by its heads.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, found, rest = data.partition(SEPARATOR)
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    h = headers(head)
    block = rest[:int(h["content-length"])]
    told = h.get("warc-block-digest", "").partition(":")
    if told[0] == "sha256" and hashlib.sha256(block).hexdigest() != told[2]:
        raise ValueError(f"block of {h.get('warc-record-id')} is damaged")
    http, _, payload = block.partition(SEPARATOR)
    digest = h.get("warc-payload-digest", "").rpartition(":")[2]
    if h["warc-type"] == "revisit":
        size, payload = int(headers(http)["content-length"]), None
    else:
        size, own = len(payload), hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            raise ValueError(f"payload of {h.get('warc-record-id')} is damaged")
        digest = own
    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
    return (None if page is None else int(page), h.get("warc-target-uri"), size, digest, h["warc-type"],
            None if refers is None else int(refers), payload)


def _open(uri: str):
    """Random access to a file by its URI (a local one, or one of a store that Arrow knows)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem().open_input_file(uri)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all packages under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With ``payloads`` also ``payload`` (null for revisits). Empty files have no
    records. One task lists a package (its directory and indexes); records are
    dealt out by blocks and read in order of place, neighbours in one read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def list_records(batches):
        for b in batches:
            for uri, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if length:
                    with _open(uri) as f:
                        at, n = [], []
                        for offset, size in locate(f, length):
                            at.append(offset), n.append(size)
                            if len(at) == 1 << 16:
                                yield _places(uri, at, n)
                                at, n = [], []
                        yield _places(uri, at, n)

    def read_records(batches):
        uri, f = None, None
        try:
            for b in batches:
                spans = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
                i = 0
                while i < len(spans):
                    if spans[i][0] != uri:
                        if f is not None:
                            f.close()
                        uri = spans[i][0]
                        f = _open(uri)
                    start, j = spans[i][1], i
                    end = start + spans[i][2]
                    while (j + 1 < len(spans) and spans[j + 1][0] == uri and spans[j + 1][1] - end <= GAP
                           and spans[j + 1][1] + spans[j + 1][2] - start <= BLOCK):
                        j += 1
                        end = max(end, spans[j][1] + spans[j][2])
                    data = memoryview(_exactly(f, start, end - start))
                    rows = [parse(bytes(data[at - start:at - start + n])) for _, at, n in spans[i:j + 1]]
                    columns = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, t) for c, t in zip(columns[:6], (
                        pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                    if payloads:
                        arrays.append(pa.array(columns[6], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    i = j + 1
        finally:
            if f is not None:
                f.close()

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    ship_package(spark)
    places = files.mapInArrow(list_records, "path string, offset bigint, length bigint")
    block = F.floor(F.col("offset") / BLOCK)
    dealt = places.repartition("path", block).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read_records, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                                          "record_type string, refers_to bigint" + ", payload binary" * payloads)


def _places(uri: str, at: list[int], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uri] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                                      names=["path", "offset", "length"])


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               payloads: bool = False) -> DataFrame:
    """Write all ``pages`` to packages in the shared folder and read the records back.

    One row for each row of ``pages``, also where keys (integers) are null or repeated;
    null html is an empty payload; a null url has no header and comes back null;
    control characters and others outside visible ASCII come back
    percent-encoded. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "packages")
    write(identify(pages, key, url, html), path)
    return read(spark, path, payloads)

"""WARC records in ZIP packages: written by executors, read back by ranges without extraction.

A package is a ZIP file of two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdx``, a line per record with its offset and length in the archive and its
length in the package's order.  The reader takes the end-of-central-directory record (ZIP64 or not) from
the tail of the file, walks the central directory, finds the stored members and fetches records by range.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, joined, shared_dir, shuffle_partitions, written
from .files import RangeFile, own_name, put

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_END64, _LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")


# ---------------------------------------------------------------- ZIP
@dataclass(frozen=True)
class Member:
    """A member as the central directory has it."""

    name: str
    method: int
    crc32: int
    stored: int
    size: int
    header: int


def zip_bytes(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """A ZIP file of stored members.  ``zip64`` writes 64-bit records even where 32 bits would do."""
    out, directory, at = [], [], 0
    for name, parts in members:
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        wide = zip64 or max(size, at) >= 0xFFFFFFFF
        raw = name.encode()
        extra = struct.pack("<2H2Q", 1, 16, size, size) if wide else b""
        local = _LOCAL.pack(b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, *([0xFFFFFFFF] * 2 if wide else [size] * 2), len(raw), len(extra))
        extra_central = struct.pack("<2H3Q", 1, 24, size, size, at) if wide else b""
        directory.append(_CENTRAL.pack(b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, *([0xFFFFFFFF] * 2 if wide else [size] * 2), len(raw), len(extra_central), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra_central)
        out += [local, raw, extra, *parts]
        at += len(local) + len(raw) + len(extra) + size
    central = sum(map(len, directory))
    out += directory
    wide = zip64 or at + central >= 0xFFFFFFFF or len(members) >= 0xFFFF
    if wide:
        out.append(_END64.pack(b"PK\6\6", _END64.size - 12, 45, 45, 0, 0, len(members), len(members), central, at))
        out.append(_LOCATOR.pack(b"PK\6\7", 0, at + central, 1))
    few = [0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF] if wide else [len(members), len(members), central, at]
    out.append(_END.pack(b"PK\5\6", 0, 0, *few, 0))
    return out


class Package:
    """A ZIP file read by ranges."""

    def __init__(self, uri: str):
        self.file = RangeFile(uri)
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.file.size - 66_000)  # the end record and its longest comment
        tail = self.file.read(tail_at, self.file.size - tail_at)
        found = tail.rfind(b"PK\5\6")
        if found < 0:
            raise ValueError("no ZIP file: it has no end record")
        _, _, _, _, count, size, start, _ = _END.unpack_from(tail, found)
        if found >= _LOCATOR.size and tail[found - _LOCATOR.size : found - _LOCATOR.size + 4] == b"PK\6\7":
            at = _LOCATOR.unpack_from(tail, found - _LOCATOR.size)[2]
            end = _END64.unpack(self.file.read(at, _END64.size))
            if end[0] != b"PK\6\6":
                raise ValueError("the ZIP64 end record is not where its locator says")
            count, size, start = end[7], end[8], end[9]
        data, at = self.file.read(start, size), 0
        for _ in range(count):
            sign, _, _, _, method, _, _, crc, stored, whole, n_name, n_extra, n_comment, _, _, _, header = _CENTRAL.unpack_from(data, at)
            if sign != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            name = data[at + _CENTRAL.size : at + _CENTRAL.size + n_name].decode()
            extra = data[at + _CENTRAL.size + n_name : at + _CENTRAL.size + n_name + n_extra]
            whole, stored, header = self._wide(extra, whole, stored, header)
            yield Member(name, method, crc, stored, whole, header)
            at += _CENTRAL.size + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Sizes and offset, from the ZIP64 extra field where the directory has only ones."""
        at, fields = 0, b""
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == 1:
                fields = extra[at + 4 : at + 4 + n]
            at += 4 + n
        out, at = [], 0
        for v in values:
            if v == 0xFFFFFFFF:
                v, at = struct.unpack_from("<Q", fields, at)[0], at + 8
            out.append(v)
        return out

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        if name not in self._starts:
            m = self.members[name]
            if m.method:
                raise ValueError(f"{name} is compressed; ranges need a stored member")
            head = _LOCAL.unpack(self.file.read(m.header, _LOCAL.size))
            self._starts[name] = m.header + _LOCAL.size + head[9] + head[10]
        return self._starts[name]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        length = self.members[name].size - offset if length is None else length
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"{name} has no bytes {offset} to {offset + length}")
        return self.file.read(self.start(name) + offset, length)

    def index(self) -> list[tuple[int, int]]:
        """Offset and length of each record in the archive member, in file order."""
        return [tuple(map(int, line.split(b" "))) for line in self.read(INDEX).splitlines()]

    def record(self, offset: int, length: int) -> Record:
        return parse_record(zlib.decompress(self.read(ARCHIVE, offset, length), 31))


# ---------------------------------------------------------------- WARC
@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of a payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block has the payload's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in data.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(data: bytes) -> Record:
    """A record from its bytes; raises if its lengths don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = _headers(head)
    n = int(headers["content-length"])
    if len(rest) != n + 4:
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- Spark
def write_archives(pages: DataFrame, least_bytes: int = 0, package_limit: int = 32 << 20, zip64: bool = False, uri: str | None = None) -> DataFrame:
    """Write a record per page into packages in the shared folder; returns ``path, records``, a written table.

    The payload is the html in UTF-8; null counts as empty.  Among pages of equal payloads of at least
    ``least_bytes`` bytes, those with the largest ``page_id`` are responses and the others revisit it;
    shorter payloads are always responses.  Rows that share the largest id are all responses.  A null id
    is smaller than any other; if all of a group are null, all are responses.  Equality is SHA-1's.
    """
    spark = pages.sparkSession
    uri = uri or shared_dir(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"))
    # Only payloads met more than once need their response's id.  Pages of a hot payload get it where they
    # are, without a shuffle; the others cross one, a payload's group being at most a small share of all.
    sized = pages.select(F.col("page_id").cast("long"), F.octet_length(html).alias("bytes"), F.sha1(html.cast("binary")).alias("_digest"))
    counts = sized.where(F.col("bytes") >= least_bytes).groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("n"))
    counts = written(counts, "payloads")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = joined(rows, counts.where("n > 1"), "_digest", total, "left")
    other = F.col("_response").isNotNull() & (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_response"))
    rows = rows.select("page_id", "url", "html", F.when(other, F.col("_response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        records: list[bytes] = []
        index: list[bytes] = []

        def close() -> pa.RecordBatch:
            path = own_name(f"{uri}/pages-{part:06d}-{number:05d}", ".zip")
            put(path, zip_bytes([(ARCHIVE, records), (INDEX, index)], zip64))
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(records)], pa.int64())})

        for batch in batches:
            for at_row in range(0, batch.num_rows, 500):
                for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.slice(at_row, 500).columns), strict=True):
                    data = _gzip(record_bytes(page_id, url, text.encode(), refers_to))
                    if records and at + len(data) > package_limit:
                        yield close()
                        number, at, records, index = number + 1, 0, [], []
                    records.append(data)
                    index.append(b"%d %d\n" % (at, len(data)))
                    at += len(data)
        if records:
            yield close()

    return written(rows.mapInArrow(run, "path string, records long"), "packages")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of packages (a DataFrame with ``path``), fetched by range.

    A response's length and digest are those of the payload read, which must be the recorded ones; a
    revisit's are the recorded ones of the full payload, and its ``payload`` is null.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for path in batch.column(0).to_pylist():
            package = Package(path)
            index = package.index()
            for first in range(0, len(index), 500):
                rows = []
                for offset, length in index[first : first + 500]:
                    r = package.record(offset, length)
                    kind, n = r.headers["warc-type"], int(r.http["content-length"])
                    digest = r.headers["warc-payload-digest"].partition(":")[2]
                    whole = kind == "response"
                    if whole and (len(r.payload) != n or digest_of(r.payload) != digest):
                        raise ValueError(f"{path}: the record at {offset} is damaged")
                    rows.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), n, digest, kind, _page(r.headers.get("warc-refers-to")), r.payload if whole and payloads else None))
                names = [x.split()[0] for x in READ.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield {n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows, strict=True), strict=True)}
            package.file.close()

    return arrow_map(packages.select("path").repartition(shuffle_partitions(spark), "path"), READ, run)

"""WARC records in ZIP-packaged archives.

``ZipReader`` finds the end record, the ZIP64 end record where there is one, and the central
directory of a ZIP file, locates its stored members and reads byte ranges of them; nothing is
extracted and only what is asked for is read. An archive holds ``archive/data.warc.gz`` (each record
its own gzip member) and ``indexes/index.cdx`` (a line a record: offset, length), both stored.

``write_archives`` has each task write the records of its rows to archives in the shared folder;
``read_archives`` reads them back with a task a share of an archive's index. Files are opened by
``pyarrow.fs``, so the folder may be a mounted one or an object store. A task writes to a name of
its own and moves the file when it is whole; an attempt that was lost leaves nothing that is read. ``s3a`` addresses, as Spark
has them, are opened as ``s3``; a scheme that pyarrow does not know is an error.

Payloads: of records with equal payloads of at least ``least`` bytes that with the smallest page_id
is a response, the others are revisits that refer to it; smaller payloads are all responses. Rows
that repeat the smallest page_id are responses too; a null page_id comes after all others. A null html
is an empty payload, and an empty table gives no rows. A payload is held whole by the task that writes or reads it, one
record at a time. page_id must be an integer. Further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import shared_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which a task begins another archive.
ARCHIVE = 128 << 20
#: Records that one reading task takes at once.
SHARE = 2000
SALT = 64
#: Hadoop's names of schemes that pyarrow has under another one.
OPENED_AS = {"s3a": "s3", "s3n": "s3"}
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = (b"PK" + bytes(x) for x in ((5, 6), (6, 6), (6, 7), (1, 2), (3, 4)))
_FULL = 0xFFFFFFFF


class ZipReader:
    """Stored and compressed members of a seekable file. ``members``: name -> (method, packed size, size, offset of the local header)."""

    def __init__(self, f: BinaryIO, size: int):
        self.f = f
        tail_at = max(0, size - 65_557)
        tail = self.at(tail_at, size - tail_at)
        i = tail.rfind(_END)
        if i < 0:
            raise ValueError("not a ZIP file: it has no end record")
        n, length, start = struct.unpack_from("<HLL", tail, i + 10)
        if i + tail_at >= 20 and (n == 0xFFFF or _FULL in (length, start)):
            locator = self.at(i + tail_at - 20, 20)
            if locator[:4] == _LOCATOR:
                end = self.at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != _END64:
                    raise ValueError("the ZIP64 locator does not point to a ZIP64 end record")
                n, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = self.at(start, length), 0
        for _ in range(n):
            if directory[p : p + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", directory, p + 20)
            offset = struct.unpack_from("<L", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, k = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # only the fields that are full in the entry itself, in this order
                    big = list(struct.unpack_from(f"<{k // 8}Q", extra, q + 4))
                    plain = big.pop(0) if plain == _FULL and big else plain
                    packed = big.pop(0) if packed == _FULL and big else packed
                    offset = big.pop(0) if offset == _FULL and big else offset
                q += 4 + k
            self.members[name] = (method, packed, plain, offset)
            p += 46 + n_name + n_extra + n_comment

    def at(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        out = self.f.read(length)
        if len(out) != length:
            raise ValueError("the file ends too early")
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(offset of its first byte in the file, length) of a stored member."""
        method, packed, _, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: no range of it can be read")
        head = self.at(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, packed

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        at, size = self.stored(name)
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ValueError(f"{name} has no such range")
        return self.at(at + start, length)


class ZipWriter:
    """Stored members, one after the other; the ZIP64 fields are always written, so sizes need not be known first."""

    def __init__(self, f: BinaryIO):
        self.f, self.pos, self.entries = f, 0, []

    def put(self, data: bytes) -> None:
        self.f.write(data)
        self.pos += len(data)

    def begin(self, name: str) -> None:
        # bit 3: size and checksum follow the data; in 64 bits, as the local header has the ZIP64 field
        self.entries.append([name.encode(), self.pos, 0, 0])
        raw = name.encode()
        self.put(struct.pack("<4sHHHHHLLLHH", _LOCAL, 45, 0x808, 0, 0, 0x21, 0, _FULL, _FULL, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def add(self, data: bytes) -> None:
        e = self.entries[-1]
        e[2] += len(data)
        e[3] = zlib.crc32(data, e[3])
        self.put(data)

    def finish(self) -> None:
        _, _, size, crc = self.entries[-1]
        self.put(struct.pack("<4sLQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        start = self.pos
        for name, offset, size, crc in self.entries:
            self.put(struct.pack("<4sHHHHHHLLLHHHHHLL", _CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, _FULL, _FULL, len(name), 28, 0, 0, 0, 0, _FULL) + name + struct.pack("<HHQQQ", 1, 24, size, size, offset))
        n, length, end = len(self.entries), self.pos - start, self.pos
        self.put(struct.pack("<4sQHHLLQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, start))
        self.put(struct.pack("<4sLQL", _LOCATOR, 0, end, 1))
        self.put(struct.pack("<4sHHHHLLH", _END, 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A WARC/1.1 record, gzipped by itself. A revisit has the HTTP head only; its Content-Length is the payload's."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {uri}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if revisit:
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields.append(f"X-Refers-To-Page-ID: {refers_to}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields of the record, HTTP head, body) of one gzip member or of a plain record."""
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the record ends too early")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = uri.partition("://")
    if not colon:
        return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
    return pafs.FileSystem.from_uri(f"{OPENED_AS.get(scheme, scheme)}://{rest}")


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), revisit, refers_to. Groups of equal payloads are found by digest and length, summed
    before the shuffle; only groups of two and more are joined back, dealt over ``SALT`` parts, so that no group meets in one task."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keys = p.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= least)
    first = keys.groupBy("digest", "n").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"),
    ).where("rows > 1").select("digest", "n", "first")
    first = written(first, "warc-groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    d = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"),
    )
    out = d.join(first, ["digest", "n", "salt"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(typed_pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes the archives; returns what there is: path, size, records (one row an archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out: list[tuple[str, int, int]] = []
        f = z = None
        at, lines, name = 0, [], ""

        def close() -> None:
            z.finish()
            z.begin(INDEX)
            z.add("".join(lines).encode())
            z.finish()
            z.close()
            f.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            out.append((f"{folder}/{name}", z.pos, len(lines)))

        rows = (r for b in batches for i, j in K.slices(*K.buffers(b.column("payload"))) for r in b.slice(i, j - i).to_pylist())
        for row in rows:
            if z is None:
                name, at, lines = f"{uuid.uuid4().hex}.wacz", 0, []
                f = fs.open_output_stream(f"{base}/.{name}")
                z = ZipWriter(f)
                z.begin(DATA)
            r = record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])
            z.add(r)
            lines.append(f"{at} {len(r)}\n")
            at += len(r)
            if at >= archive:
                close()
                z = None
        if z is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "size", "records"],
        )

    # written: the archives are made once, however often they are read
    return written(typed_pages.mapInArrow(run, "path string, size long, records long"), "warc-archives")


def read_archives(archives: DataFrame, share: int = SHARE) -> DataFrame:
    """page_id, url, payload (null in a revisit), payload_bytes, payload_digest, record_type, refers_to of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = open_fs(row["path"])
                with fs.open_input_file(path) as f:
                    z = ZipReader(f, f.size())
                    base, _ = z.stored(DATA)
                    own = z.read(INDEX).split(b"\n")[row["first"] : row["first"] + share]
                    rows = []
                    for line in own:
                        if line:
                            offset, length = map(int, line.split())
                            fields, http, body = parse(z.at(base + offset, length))
                            size = next(
                                (int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")),
                                len(body),
                            )
                            page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                            kind = fields["warc-type"]
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
                                raise ValueError(f"{row['path']}: the payload at {offset} is broken")
                            rows.append((int(page) if page else None, fields["warc-target-uri"], body if kind == "response" else None, size, digest, kind, int(refers) if refers else None))
                            if len(rows) == 256:
                                yield batch(rows)
                                rows = []
                    yield batch(rows)

    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)

    parts = archives.select(
        "path",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(share).cast("long"))).alias("first"),
    )
    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    parts = parts.repartition(max(n, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "first")
    return parts.mapInArrow(
        run,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    return read_archives(write_archives(typed(pages, least), shared_path(pages.sparkSession, "warc")))

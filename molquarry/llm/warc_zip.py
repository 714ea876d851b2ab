"""WARC records in ZIP packages, written and read by ranges.

A package is a ZIP file of stored members: archive/data.warc.gz, a WARC/1.1 file with each record a gzip member of its
own, and indexes/index.cdx, a line `record id, offset, length` for every record, offsets counted in the WARC
member. Members are never compressed by the ZIP, so a record is a byte range of the package.

The reader parses the package's end: the end-of-central-directory record, its ZIP64 form where there is one, and the
central directory with ZIP64 extra fields. It checks that a member is stored, reads the index by its range, deals the
records over the tasks in stretches of the archive, and reads each stretch by one range. Nothing is extracted.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm.common import fresh_path, local_path, settled, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Signatures and fixed sizes of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
#: Bytes of a stretch of records that a task reads at once.
STRETCH = 4_000_000
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"


def _store(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    offset: int
    size: int


def members(source) -> list[Member]:
    """The members of a ZIP file from its central directory. `source` has size() and read_at(length, offset)."""
    size = source.size()
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = source.read_at(56, at)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = source.read_at(length, start), 0, []
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("bad central directory")
        method, packed, plain, n, e, c = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20)
        (local,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n].decode("utf-8")
        extra, k = raw[at + 46 + n : at + 46 + n + e], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                values = list(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + m
        out.append(Member(name, method, local, packed))
        at += 46 + n + e + c
    return out


def stored_range(source, member: Member) -> tuple[int, int]:
    """(first byte, length) of a stored member's data."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members have records at known places")
    head = source.read_at(30, member.offset)
    if head[:4] != LOCAL:
        raise ValueError("bad local header")
    n, e = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + n + e, member.size


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _page_record(page: dict) -> tuple[str, bytes]:
    """(record id, gzip member) of a page; a revisit's block is its HTTP header alone, which tells the payload's length."""
    name = f"{ID}{'' if page['page_id'] is None else page['page_id']}"
    payload = page["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    url = "".join((page["url"] or "about:blank").split())
    headers = [("WARC-Record-ID", f"<{name}>"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{page['digest']}")]
    if page["first"] is None:
        return name, _record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID}{page['first']}>")]
    return name, _record("revisit", headers, http)


def _parsed(raw: bytes) -> dict:
    """The fields of an unpacked record that a page has."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    name, refers = fields["WARC-Record-ID"][len(ID) + 1 : -1], fields.get("WARC-Refers-To")
    return {
        "page_id": int(name) if name else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers[len(ID) + 1 : -1]) if refers else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(told["Content-Length"]),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the page that a page revisits, else null.

    Of equal payloads (same SHA-1 and length) of at least least_bytes the largest page_id is the response; ids that tie for
    it are all responses, null ids revisit it. The groups of two or more are few or many: they are written first, so
    that Spark knows their size and sends them to all tasks or shuffles by digest, splitting skewed ones."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1 and most is not null").drop("n")
    rows = rows.join(written(groups, "copies"), ["digest", "size"], "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most")).alias("first"))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one package a partition of (page_id, url, payload, digest, first) rows into `folder`; returns (path, n). A
    package is written under its attempt's name and moved at its end, so a repeated task leaves a whole one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context, (store, path) = TaskContext.get(), _store(folder)
        store.create_dir(path, recursive=True)
        temporary, name = f"{path}/.{context.taskAttemptId()}", f"part-{context.partitionId():06d}.wacz"
        index, at = [], 0
        with store.open_output_stream(temporary) as sink, zipfile.ZipFile(_Ahead(sink), "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as out:
                while first is not None:
                    for k in range(0, first.num_rows, 200):
                        for page in first.slice(k, 200).to_pylist():
                            record, raw = _page_record(page)
                            out.write(raw)
                            index.append(f"{record} {at} {len(raw)}\n")
                            at += len(raw)
                    first = next(batches, None)
            package.writestr(zipfile.ZipInfo(INDEX), "".join(index))
        store.move(temporary, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [len(index)]})

    return written(pages.mapInArrow(write, "path string, n long"), "packages")


class _Ahead(io.RawIOBase):
    """A sink that only goes ahead, as zipfile wants it."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.sink.write(bytes(data))

    def flush(self) -> None:
        self.sink.flush()


def package_index(packages: DataFrame) -> DataFrame:
    """(path, start, length, sizes): the stretches of records of every package (path); start is a place in the package."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = _store(row["path"])
            with store.open_input_file(path) as source:
                found = {m.name: m for m in members(source)}
                data, _ = stored_range(source, found[DATA])
                at, size = stored_range(source, found[INDEX])
                lines = [x.split(b" ") for x in source.read_at(size, at).splitlines()]
            out, sizes, start = [], [], None
            for _, offset, length in sorted(lines, key=lambda x: int(x[1])):
                if sizes and (int(offset) != start + sum(sizes) or sum(sizes) >= STRETCH):
                    out.append((data + start, sizes))
                    sizes = []
                start = int(offset) if not sizes else start
                sizes.append(int(length))
            if sizes:
                out.append((data + start, sizes))
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(out)), pa.array([s for s, _ in out], pa.int64()), pa.array([n for _, n in out], pa.list_(pa.int64()))], names=["path", "start", "sizes"])

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(parts, "path").mapInArrow(look, "path string, start long, sizes array<long>")


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of every record of the packages
    (path). A payload is null for a revisit. Damaged records raise an error."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    if payloads:
        kinds["payload"] = pa.binary()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = _store(row["path"])
            with store.open_input_file(path) as source:
                raw, at, out = source.read_at(sum(row["sizes"]), row["start"]), 0, []
            for n in row["sizes"]:
                out.append(_parsed(zlib.decompress(raw[at : at + n], 31)))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in kinds.items()], names=list(kinds))

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    index = package_index(packages)
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "path", "start").mapInArrow(read, schema)


def page_digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes `pages` (page_id, url, html) to packages and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A null html is an empty payload, a null page_id stays null, repeated rows are records each.
    Other columns are not read. An empty table gives no rows."""
    packages = settled(lambda: write_packages(with_revisits(pages), fresh_path(spark, "warc")), "packages")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from DuckDB.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS most, count(*) OVER (PARTITION BY h) AS n FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> most THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> most THEN most END AS refers_to
FROM d
"""

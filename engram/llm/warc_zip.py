"""WARC records in ZIP packages, written and read by ranges.

A package is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, one JSON line per record with its
offset and length inside the archive member. The reader parses the end record, the ZIP64
locator and end record where present, and the central directory; finds where each stored
member's bytes lie; and range-reads records, without extracting anything.

Packages live in a folder that driver and executors share, named by a URI that
``pyarrow.fs`` can open.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ------------------------------------------------------------------


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the full payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes) -> dict:
    """Headers and payload of a WARC record; the payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["content-length"])]
    http_head, _, payload = body.partition(b"\r\n\r\n")
    return {"warc": fields, "http": _fields(http_head), "payload": None if fields["warc-type"] == "revisit" else payload}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# --- packages -----------------------------------------------------------------


class PackageWriter:
    """Gathers records and gives the bytes of a ZIP package."""

    def __init__(self):
        self.buffer = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, data: bytes, url: str | None, kind: str) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{_clean(url)} 19700101000000 {json.dumps({'type': kind, 'offset': self.size, 'length': len(packed)})}")
        self.size += len(packed)

    def finish(self) -> bytes:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        return self.buffer.getvalue()


class PackageReader:
    """Directory of a ZIP file given only ranged reads (``seek`` and ``read``)."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - 65_557 - 20)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory record: not a ZIP file")
        n, _, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        length = struct.unpack("<I", tail[end + 12 : end + 16])[0]
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # ZIP64 locator
            where = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
            end64 = self.range(where, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end record")
            n, length, at = struct.unpack("<QQQ", end64[32:56])
        self.members = dict(self._entries(self.range(at, length), n))

    def range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the file ends too early")
        return data

    @staticmethod
    def _entries(directory: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, = struct.unpack("<H", directory[at + 10 : at + 12])
            packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            where, = struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, size = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                    wide = iter(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    where = next(wide) if where == 0xFFFFFFFF else where
                extra = extra[4 + size :]
            yield name, (method, where, packed)
            at += 46 + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie: offset in the file, length."""
        method, where, length = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed and can't be read by ranges")
        head = self.range(where, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        return where + 30 + n_name + n_extra, length

    def records(self, span: int = 8_000_000) -> Iterator[bytes]:
        """Every record of the index; neighbours are read together, at most ``span`` bytes at a time."""
        at, length = self.stored(INDEX)
        text = self.range(at, length).decode("utf-8")
        places = [(x["offset"], x["length"]) for x in (json.loads(line[line.rindex(" {") :]) for line in text.split("\n") if line)]
        base, _ = self.stored(DATA)
        i = 0
        while i < len(places):
            j, first = i, places[i][0]
            while j < len(places) and (j == i or places[j][0] + places[j][1] - first <= span):
                j += 1
            data = memoryview(self.range(base + first, places[j - 1][0] + places[j - 1][1] - first))
            for offset, size in places[i:j]:
                yield zlib.decompress(data[offset - first : offset - first + size], 31)
            i = j


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- operators ----------------------------------------------------------------


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: the record is a response) of every row.

    Null html is empty. Of equal payloads of at least ``min_bytes`` the smallest page_id is referred
    to; a null page_id only by none. Repeated rows are kept. Identities are settled on
    (page_id, digest) pairs alone; the html itself is joined once, by a key that no group of copies makes hot.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    ids = rows.select("page_id", "digest", "n").where(F.col("n") >= min_bytes).groupBy("page_id", "digest").agg(F.lit(1).alias("one"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1")
    later = beside(ids, "digest").join(beside(first, "digest"), ["digest", "beside"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    return rows.join(later, rows["page_id"].eqNullSafe(later["_id"]) & (rows["digest"] == later["_digest"]), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 100, package_bytes: int = 32_000_000) -> DataFrame:
    """Writes packages of about ``package_bytes`` and returns their names (uri, n_records).

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` the record with
    the smallest page_id is the response and others revisit it; repeated rows with that page_id
    are all responses. A null page_id is no smallest one unless all of the group are null, and
    then all are responses. Each attempt of a task writes files of its own name; only those of
    the attempts that succeeded are returned, so a lost executor leaves no half-read package.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple[str, int]] = []
        writer = PackageWriter()

        def put() -> None:
            nonlocal writer
            system, path = _open(folder)
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(writer.finish())
            made.append((f"{folder}/{name}", len(writer.lines)))
            writer = PackageWriter()

        for b in batches:
            for page_id, url, page, digest, refers_to in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                revisit = not pd.isna(refers_to)
                data = record(page_id, url, page.encode("utf-8", "surrogatepass"), digest, int(refers_to) if revisit else None, revisit)
                writer.add(data, url, "revisit" if revisit else "response")
                if writer.size >= package_bytes:
                    put()
        if writer.lines:
            put()
        yield pd.DataFrame(made, columns=["uri", "n_records"])

    # text and not numbers, so that pandas doesn't turn identifiers into floats where some are null
    rows = resolve(pages, min_bytes).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return rows.mapInPandas(work, "uri string, n_records long")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """One row per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from the payload that was read and checked against
    its header; a revisit's are those of the full payload, from its headers. A record without a
    page_id has a null one; repeated records are repeated rows; without packages there are none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["uri"]:
                system, path = _open(uri)
                out = []
                with system.open_input_file(path) as file:
                    for data in PackageReader(file, file.size()).records():
                        r = parse_record(data)
                        warc, payload = r["warc"], r["payload"]
                        digest = warc["warc-payload-digest"].removeprefix("sha256:")
                        size = int(r["http"]["content-length"])
                        if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{uri}: the payload of {warc['warc-record-id']} doesn't match its digest")
                        out.append((_page(warc["warc-record-id"]), size, digest, warc["warc-type"], _page(warc.get("warc-refers-to"))))
                frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return packages.select("uri").mapInPandas(work, RESULT)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as packages in the shared folder and reads all of them back.

    One row per input row, repeated ones too; nulls are treated as by ``write_packages``; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "packages")
    listed = new_path(spark, "package-list")
    write_packages(pages, folder, **options).write.parquet(listed)
    names = spark.read.schema("uri string, n_records long").parquet(listed)
    n = max(1, names.count())
    return read_packages(spark, names.repartition(min(n, 4096)))


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS h,
         min(page_id) OVER (PARTITION BY b) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

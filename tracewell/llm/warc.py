"""WARC records in ZIP packages: a writer, and a reader that finds its way by directory and index.

A package holds stored (not deflated) members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, a line of JSON per record with its offset and length. The reader parses the end of
the ZIP, its ZIP64 part where there is one, and the central directory, locates the members, reads the
index, then fetches neighbouring records by ranges of bounded length. Nothing is extracted.

Packages go to the shared folder, each under a name of its own; a manifest table names those of
tasks that succeeded, so a lost executor or a second attempt leaves at most an unused file. Payloads that repeat are written
once: the record with the largest page_id is the response, others are revisits that name it.

Null html is an empty payload; null urls are left out; rows whose page_id is null are revisits of the response where their
payload has a page_id elsewhere. Rows that repeat a page_id and payload are all written, as responses if the id is the largest.
An empty table gives no package and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.text import slices, written
from tracewell.session import scratch_dir
from tracewell.sources import storage

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PACKAGE_BYTES = 32 << 20  # of payload in one package; one larger payload has a package of its own
PACKAGES_PER_TASK = 2
RANGE_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format: signatures, and what stands in 32-bit fields when the ZIP64 part has the value.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int  # where the local header begins
    size: int


def central_directory(file: BinaryIO, size: int) -> dict[str, Member]:
    """Members of a ZIP by name. `file` can seek; only its tail and the directory are read."""
    tail_at = max(0, size - 22 - FULL16 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)  # a comment may contain the signature
    if end < 0:
        raise ValueError("not a ZIP: no end of the central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64 and (count == FULL16 or FULL32 in (length, at)):
        file.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record = file.read(56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    file.seek(at)
    raw, p, members = file.read(length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", raw, p + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name, q = raw[p + 46 : p + 46 + n_name].decode(), p + 46 + n_name
        p = q + n_extra + n_comment
        while q + 4 <= p - n_comment:
            kind, n = struct.unpack_from("<HH", raw, q)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", raw, q + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            q += 4 + n
        members[name] = Member(name, method, header, packed)
    return members


def data_offset(file: BinaryIO, member: Member) -> int:
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored, so it cannot be read by ranges")
    file.seek(member.header)
    header = file.read(30)
    if header[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def read_package(file: BinaryIO, size: int) -> Iterator[bytes]:
    """All records of a package in the order of its index, unzipped one by one."""
    members = central_directory(file, size)
    index, archive = members[INDEX], members[ARCHIVE]
    file.seek(data_offset(file, index))
    entries = [json.loads(line) for line in file.read(index.size).splitlines()]
    base, k = data_offset(file, archive), 0
    while k < len(entries):
        start, stop = entries[k]["offset"], k
        while stop < len(entries) and (stop == k or entries[stop]["offset"] + entries[stop]["length"] - start <= RANGE_BYTES):
            stop += 1
        end = max(e["offset"] + e["length"] for e in entries[k:stop])
        if end > archive.size:
            raise ValueError("the index leads beyond the archive")
        file.seek(base + start)
        block = file.read(end - start)
        for e in entries[k:stop]:
            yield zlib.decompress(block[e["offset"] - start : e["offset"] - start + e["length"]], 31)
        k = stop


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case), payload."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    head, _, block = record.partition(b"\r\n\r\n")
    warc = fields(head)
    block = block[: int(warc["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(head), payload


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, response: int | None) -> bytes:
    """A response, or with `response` (a page_id) a revisit of it, which has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if response is not None:
        head += [f"WARC-Refers-To: {record_id(response)}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """Gathers records, then writes them as one ZIP."""

    def __init__(self) -> None:
        self.archive, self.index, self.payload_bytes = io.BytesIO(), [], 0

    def add(self, page_id: int | None, record: bytes, payload_bytes: int) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.index.append({"page_id": page_id, "offset": self.archive.tell(), "length": len(data)})
        self.archive.write(data)
        self.payload_bytes += payload_bytes

    def write(self, out: BinaryIO) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(ARCHIVE, "w", force_zip64=True) as f:
                f.write(self.archive.getbuffer())
            z.writestr(INDEX, "".join(json.dumps(x) + "\n" for x in self.index))


def sha1_base32(payload: Column) -> Column:
    """Base32 of the SHA-1: eight characters for each ten hex digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages (page_id, url, html); the manifest: path, size, n_records."""
    folder = folder or scratch_dir(pages.sparkSession, "packages")
    storage.opened(folder)  # a scheme that tasks cannot open fails here, before any job
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", "url", "html", sha1_base32(payload).alias("sha1"))
    long_enough = F.octet_length(payload) >= min_bytes
    owners = written(narrow.where(long_enough).groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    same = F.col("page_id").eqNullSafe(F.col("owner"))
    typed = narrow.join(owners, "sha1", "left").withColumn("response", F.when(long_enough & ~same, F.col("owner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base, _ = storage.opened(folder)
        disk.create_dir(base, recursive=True)

        def flush(package: Package) -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with disk.open_output_stream(path) as out:
                package.write(out)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([disk.get_file_info(path).size]), pa.array([len(package.index)])], names=["path", "size", "n_records"])

        package = Package()
        for batch in slices(batches, "html"):
            for page_id, url, html, sha1, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "response"))):
                data = (html or "").encode()
                package.add(page_id, build_record(page_id, url, data, sha1, response), len(data))
                if package.payload_bytes >= PACKAGE_BYTES:
                    yield flush(package)
                    package = Package()
        if package.index:
            yield flush(package)

    return written(typed.mapInArrow(run, "path string, size bigint, n_records bigint"), "manifest").withColumn("folder", F.lit(folder))


def read_packages(manifest: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the full payload), intact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, folder in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "folder"))):
                rows = []
                with storage.opened(folder)[0].open_input_file(path) as file:
                    for record in read_package(file, size):
                        warc, http, payload = parse_record(record)
                        kind, named = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        own = digest(payload) if kind == "response" else named
                        size_of = len(payload) if kind == "response" else int(http["content-length"])
                        refers = page_of(warc["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, refers, size_of, own, own == named))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"
    # rows of the manifest are small but stand for megabytes each: a stated number of tasks, which Spark does not merge
    tasks = -(-max(manifest.count(), 1) // PACKAGES_PER_TASK)
    return manifest.repartition(tasks, "path").mapInArrow(run, schema)


def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_packages(write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS owner,
         list_aggregate(list_transform(generate_series(0, 3), lambda g: list_aggregate(list_transform(generate_series(7, 0, -1), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(1 + 10 * g AS INT), 10) AS BIGINT) >> (5 * k)) & 31) + 1 AS INT), 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""

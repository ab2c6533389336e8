from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from tests.oracle import compare, connect
from tracewell.llm import warc


def packed(records, comment=b""):
    package = warc.Package()
    for i, r in enumerate(records):
        package.add(i, r, len(r))
    out = io.BytesIO()
    package.write(out)
    if comment:
        with zipfile.ZipFile(out, "a") as z:
            z.comment = comment
    return out.getvalue()


def read(data):
    return list(warc.read_package(io.BytesIO(data), len(data)))


def test_packages_come_back():
    records = [b"x" * n for n in (0, 1, 70_000, 3_000_000, 5)]
    assert read(packed(records)) == records
    assert read(packed(records, b"PK\5\6 in the comment " + b"c" * 60_000)) == records
    assert zipfile.ZipFile(io.BytesIO(packed(records))).namelist() == [warc.ARCHIVE, warc.INDEX]


def test_zip64_directory():
    """The same package, its end rewritten so that only the ZIP64 part has the numbers."""
    records = [b"a" * 10, b"b" * 20]
    data = packed(records)
    end = data.rfind(warc.END)
    count, length, at = struct.unpack_from("<HII", data, end + 10)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    last = warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert read(data[:end] + end64 + locator + last) == records
    # offsets and sizes of an entry in its extra field
    members = warc.central_directory(io.BytesIO(data), len(data))
    entry = data[at : at + length]
    name_len, extra_len = struct.unpack_from("<HH", entry, 28)
    first = 46 + name_len
    wide = struct.pack("<HHQQQ", 1, 24, members[warc.ARCHIVE].size, members[warc.ARCHIVE].size, members[warc.ARCHIVE].header)
    changed = entry[:20] + struct.pack("<IIHH", warc.FULL32, warc.FULL32, name_len, len(wide)) + entry[32:42] + struct.pack("<I", warc.FULL32) + entry[46:first] + wide + entry[first + extra_len :]
    out = data[:at] + changed + warc.END + struct.pack("<HHHHIIH", 0, 0, count, count, len(changed), at, 0)
    assert read(out) == records


def test_damage_is_reported():
    with pytest.raises(ValueError):
        read(b"no zip at all")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, b"x" * 100)
        z.writestr(warc.INDEX, b"{}")
    with pytest.raises(ValueError, match="not stored"):
        read(out.getvalue())


def test_query(spark, sf):
    got, want = compare(warc.op1_warc_packages(spark, sf), warc.SQL, connect(sf))
    assert got == want


def test_edges(spark):
    rows = [(1, "u", "same", 1), (5, None, "same", 2), (3, "a\r\nb", "same", 3), (2, "e", None, 4), (7, "e", "", 5), (9, "n", "é" * 40_000_00, 6), (None, "q", "same", 7), (None, "q", "alone", 8), (4, "d", "dup", 9), (4, "d", "dup", 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha1 int")
    out = warc.read_packages(warc.write_packages(pages)).collect()
    assert len(out) == len(rows) and all(r["intact"] for r in out)
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out), key=repr)
    want = [(1, "revisit", 5, 4), (5, "response", None, 4), (3, "revisit", 5, 4), (2, "revisit", 7, 0), (7, "response", None, 0), (9, "response", None, 8_000_000), (-1, "revisit", 5, 4), (-1, "response", None, 5), (4, "response", None, 3), (4, "response", None, 3)]
    assert got == sorted(want, key=repr)
    assert {r["url"] for r in out if r["page_id"] == 3} == {"a%0D%0Ab"}
    for r in out:
        html = next(h for i, _, h, _ in rows if i == r["page_id"] and len((h or "").encode()) == r["payload_bytes"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    few = {r["page_id"]: r["record_type"] for r in warc.read_packages(warc.write_packages(pages, min_bytes=4)).collect()}
    assert few[2] == few[7] == "response" and few[1] == "revisit"
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_folders_that_cannot_be_opened_fail_early(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string")
    with pytest.raises(ValueError, match="opened under"):
        warc.write_packages(pages, "wasb://container/folder")

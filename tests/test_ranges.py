"""Listings and byte ranges of files: what is found, what is read, and what is not."""

from __future__ import annotations

import hashlib
import io
import json
import os
import random

import pyarrow as pa
import pytest

from tracewell.operators import sidefeeds
from tracewell.plans.sync import sync
from tracewell.plans.warehouse import Warehouse
from tracewell.sources import ranges as R
from tracewell.sources import storage
from tracewell.sources.listing import list_tree
from tracewell.streaming import growing


def brute(raw: bytes, end: int, how: R.Lines) -> list[tuple[int, int, bytes]]:
    """(begin, end, text) of all lines, byte by byte."""
    raw, out, i = raw[:end], [], 0
    while i < len(raw):
        j = i
        while j < len(raw) and raw[j] != 10 and not (how.universal and raw[j] == 13):
            j += 1
        if j == len(raw):
            return [*out, (i, j, raw[i:])] if how.unfinished else out
        after = j + 2 if how.universal and raw[j : j + 2] == b"\r\n" else j + 1
        out.append((i, after, raw[i:j]))
        i = after
    return out


def test_splits_give_every_line_once():
    rng = random.Random(1)
    for _ in range(4000):
        raw = bytes(rng.choices(b"ab\n\r\xc3\xa9", k=rng.randrange(30)))
        how = R.Lines(rng.random() < 0.5, rng.random() < 0.5)
        end = rng.randrange(len(raw) + 1)
        cuts = sorted({0, end, *(rng.randrange(end + 1) for _ in range(rng.randrange(4)))})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            for starts, ends, values in R.read_range(io.BytesIO(raw), a, b, end, how, rng.randrange(1, 12)):
                got += zip(starts.tolist(), ends.tolist(), values.to_pylist())
        assert got == brute(raw, end, how), (raw, cuts, how)


class Counted(io.BytesIO):
    """Remembers the first byte that was read, and how many were."""

    first, total = None, 0

    def read(self, n=-1):
        at = self.tell()
        out = super().read(n)
        if out:
            self.first = at if self.first is None else min(self.first, at)
            self.total += len(out)
        return out


def test_bytes_before_a_range_are_not_read():
    raw = b"".join(b"line %d\n" % i for i in range(100_000))
    start = raw.index(b"line 99000\n")
    stream = Counted(raw)
    lines = [v for _, _, values in R.read_range(stream, start, len(raw), len(raw), buffer=1000) for v in values.to_pylist()]
    assert lines[0] == b"line 99000" and len(lines) == 1000
    assert stream.first == start - 1 and stream.total <= len(raw) - start + 1
    stream = Counted(raw + b"half a li")
    found = R.place(stream, len(raw) + 9, start, 0, None)
    assert (found.start, found.complete) == (start, len(raw)) and stream.total <= R.HEAD_BYTES + (64 << 10)


def test_place_knows_replaced_files():
    old = b"first line\nsecond line\n"
    seen = R.place(io.BytesIO(old), len(old), 0, 0, None)
    assert (seen.start, seen.complete, seen.replaced) == (0, len(old), False)
    where = lambda new: (lambda p: (p.start, p.complete, p.replaced))(R.place(io.BytesIO(new), len(new), seen.complete, seen.head_bytes, seen.head))
    assert where(old) == (len(old), len(old), False)
    assert where(old + b"third\nhalf") == (len(old), len(old) + 6, False)
    assert where(b"short\n") == (0, 6, True)
    assert where(b"another first line\nand a second\nthird\n") == (0, 38, True)
    assert where(b"FIRST line\nsecond line\n") == (0, len(old), True)


def test_long_lines_and_folders_that_are_missing(spark, tree):
    path = tree.write("a/long.txt", "x" * 300_000 + "\ny\r\nz")
    listed = list_tree(spark, [(f"{tree.root}/a", False), (f"{tree.root}/none", True)])
    lines = R.lines_of(listed, 300_000).orderBy("line_id").collect()
    assert [(r.line_id, len(r.value)) for r in lines] == [(0, 300_000), (300_001, 1), (300_004, 1)] and lines[0].file_path == path
    with pytest.raises(ValueError, match="opened under"):
        list_tree(spark, [("wasb://x/y", True)])


def test_paths_open_by_scheme(tmp_path):
    assert storage.opened("/a b/c")[1:] == ("/a b/c", "")
    assert storage.opened("file:///a%20b/c")[1:] == ("/a b/c", "")
    assert storage.opened("a:b/c")[1:] == ("a:b/c", "")


@pytest.mark.parametrize("entries", [20_000, 2])
def test_listing_equals_a_walk(spark, tree, entries):
    rng = random.Random(3)
    for i in range(60):
        folder = "/".join(rng.choices("abc", k=rng.randrange(4)))
        tree.write(f"in/{folder}/f{i}.txt", "x" * rng.choice([0, 0, 5]), 1000 + i)
    tree.write("flat/x.txt", "1", 5.25)
    tree.write("flat/below/y.txt", "1")
    want = {os.path.join(d, f) for d, _, names in os.walk(f"{tree.root}/in") for f in names}
    rows = list_tree(spark, [(f"{tree.root}/in", True), (f"{tree.root}/flat/", False)], entries=entries).collect()
    assert {r.file_path for r in rows if r.root.endswith("/in")} == want and len(rows) == 61
    assert all((r.mtime_ms, r.file_size) == (int(os.stat(r.file_path).st_mtime * 1000), os.path.getsize(r.file_path)) for r in rows)
    assert [(r.file_path, r.mtime_ms) for r in rows if r.root.endswith("/flat")] == [(f"{tree.root}/flat/x.txt", 5250)]


def hook_lines(n, what="x"):
    return "".join(f"2026-01-31 10:28:{i % 60:02d} {what} {i}\n" for i in range(n))


def test_synced_part_of_a_log_is_not_read_again(spark, tree, tmp_path):
    out = str(tmp_path / "tables")
    text = hook_lines(1000)
    tree.write("logs/pretooluse.log", text, 1000)
    sync(spark, tree.root, out)
    # were these bytes read again, their lines would be events
    spoiled = text[: R.HEAD_BYTES] + "\n2026-01-31 10:28:00 spoiled" * ((len(text) - R.HEAD_BYTES) // 28 + 1)
    tree.write("logs/pretooluse.log", spoiled[: len(text) - 1] + "\n" + hook_lines(3, "new"), 1001)
    sync(spark, tree.root, out)
    events = Warehouse(spark, out).table("hook_events").orderBy("id").collect()
    assert [r.id for r in events] == list(range(1, 1004))


def test_logs_that_were_replaced(spark, tree, tmp_path):
    out, log = str(tmp_path / "tables"), "logs/sessionstart.log"

    def ids():
        sync(spark, tree.root, out)
        wh = Warehouse(spark, out)
        return [r.id for r in wh.table("hook_events").orderBy("id").collect()], wh.state["hooks_sessionstart"].last_offset

    tree.write(log, hook_lines(5), 1000)
    assert ids() == (list(range(1, 6)), len(hook_lines(5)))
    tree.write(log, hook_lines(8, "other"), 1001)  # replaced and longer than before
    assert ids() == (list(range(1, 14)), len(hook_lines(8, "other")))
    tree.write(log, hook_lines(9, "other"), 1002)  # grew
    assert ids()[0] == list(range(1, 15))
    tree.write(log, hook_lines(2), 1003)  # shrank
    assert ids() == (list(range(1, 17)), len(hook_lines(2)))
    tree.write(log, "half a line", 1004)  # replaced by something unfinished
    assert ids() == (list(range(1, 17)), 0)
    assert ids()[0] == list(range(1, 17))


def test_empty_files_are_listed_and_counted(spark, tree, tmp_path):
    out = str(tmp_path / "tables")
    for path in ("projects/p/A.jsonl", "projects/p/s/subagents/x.jsonl", "todos/a.json", "debug/d.txt", "history/n.md", "projects/p/sessions-index.json"):
        tree.write(path, "", 1000)
    report = sync(spark, tree.root, out)
    assert report == {"sessions": (1, 0), "subagents": (1, 0), "deleted_sessions": (1, 0), "todos": (1, 0), "debug": (1, 1), "history": (1, 1)}
    wh = Warehouse(spark, out)
    assert [(r.first_line, r.line_count, r.size_bytes) for r in wh.table("debug_logs").collect()] == [("", 0, 0)]
    assert [(r.description, r.content) for r in wh.table("research_history").collect()] == [("n", "")]
    assert wh.table("sessions").count() == 0 and sync(spark, tree.root, out)["debug"] == (0, 0)


def test_index_of_a_moved_tree(spark, tree, tmp_path):
    tree.write("projects/p/here.jsonl", "", 1000)
    entries = '[{"sessionId":"here","fullPath":"s3a://old/home/projects/p/here.jsonl"},{"sessionId":"gone","fullPath":"s3a://old/home/projects/p/gone.jsonl"}]'
    tree.write("projects/p/sessions-index.json", '{"entries":' + entries + "}", 1000)
    sync(spark, tree.root, str(tmp_path / "tables"))
    assert [r.session_id for r in Warehouse(spark, str(tmp_path / "tables")).table("deleted_sessions").collect()] == ["gone"]


def test_stream_of_growing_files(spark, tree, tmp_path):
    out, checkpoint = str(tmp_path / "lines"), str(tmp_path / "ck")

    def drain():
        stream = growing.growing_lines(spark, tree.root, "*.txt", split_bytes="7")
        query = (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        assert query.exception() is None
        rows = spark.read.parquet(out).orderBy("batch_id", "file_path", "block_start", "line_id").collect()
        return [(r.file_path.rsplit("/", 1)[1], r.value) for r in rows]

    tree.write("a.txt", "one\ntwo\nhal", 1000)
    tree.write("b/c.txt", "x\n", 1000)
    tree.write("b/other.log", "no\n", 1000)
    first = [("a.txt", "one"), ("a.txt", "two"), ("c.txt", "x")]
    assert drain() == first
    assert drain() == first  # nothing new, after a restart
    tree.write("a.txt", "one\ntwo\nhalf a line\nthree\n", 1001)
    tree.write("d.txt", "", 1001)
    grown = [*first, ("a.txt", "half a line"), ("a.txt", "three")]
    assert drain() == grown
    tree.write("a.txt", "uno\ndos\ntres y mas de lo que era antes\n", 1002)  # replaced and longer
    tree.write("d.txt", "late\n", 1002)
    assert drain() == [*grown, ("a.txt", "uno"), ("a.txt", "dos"), ("a.txt", "tres y mas de lo que era antes"), ("d.txt", "late")]


def test_small_files_of_a_stream_share_tasks(tree):
    for i in range(300):
        tree.write(f"p{i % 7}/f{i}.jsonl", f"line {i}\nand more\nhalf", 1000 + i)
    tree.write("long.jsonl", "x\n" * 100_000, 1000)
    reader = growing.GrowingReader({"path": tree.root, "pattern": "*.jsonl", "tasks": "4", "split_bytes": "1000000"})
    end = reader.latestOffset()
    parts = reader.partitions({}, json.loads(json.dumps(end)))
    whole = sum(len(p.ranges) for p in parts)
    assert whole == 301 and len(parts) < 30 and len(json.dumps(end)) < 130 * 301
    got = [r for p in parts for b in reader.read(p) for r in zip(b.column("file_path").to_pylist(), b.column("value").to_pylist())]
    want = [(f"{tree.root}/p{i % 7}/f{i}.jsonl", v) for i in range(300) for v in (b"line %d" % i, b"and more")]
    assert sorted(got) == sorted(want + [(f"{tree.root}/long.jsonl", b"x")] * 100_000)
    assert len([b for p in parts for b in reader.read(p)]) <= len(parts) + 4
    few = growing.GrowingReader({"path": tree.root, "pattern": "*.jsonl", "tasks": "4"})
    assert 4 <= len(few.partitions({}, end)) <= 5
    # an offset of an earlier checkpoint: whole paths, named fields, whole fingerprints
    path = f"{tree.root}/p1/f1.jsonl"
    old = {path: {"mtime_ms": 1, "size": 7, "end": 7, "head_bytes": 7, "head": hashlib.sha256(b"line 1\n").hexdigest(), "turn": 0}}
    again = growing.GrowingReader({"path": tree.root, "pattern": "f1.jsonl", "tasks": "1"})
    assert again.partitions({}, old)[0].ranges == [(path, 1, 0, 7, 7)]
    assert [p.ranges for p in again.partitions(old, again.latestOffset())] == [[(path, 1001000, 7, 16, 16)]]


def test_index_files_are_read_once(spark, tree, tmp_path):
    good = '{"originalPath":"/o","entries":[{"sessionId":"a","summary":"s"},{"sessionId":""},7,{"sessionId":"b","created":"never"}]}'
    for name, text in (("p", good), ("q", "[1]"), ("r", '{"entries":{}}'), ("s", "{}"), ("t", "no json"), ("u", '{"entries":[]}')):
        tree.write(f"projects/{name}/sessions-index.json", text, 1000)
    read = []

    def stage(rows):
        path = str(tmp_path / f"rows{len(read)}")
        read.append(path)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    whole = R.read_whole(list_tree(spark, [(f"{tree.root}/projects", True)]))
    entries, rejects = sidefeeds.index_entries(whole, stage)
    assert len(read) == 1
    for df in (entries, rejects):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    plain, plain_rejects = sidefeeds.index_entries(whole)
    assert sorted(map(tuple, entries.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    rows = sorted((r.file_path.split("/")[-2], r.scope, r.line) for r in rejects.collect())
    assert rows == sorted((r.file_path.split("/")[-2], r.scope, r.line) for r in plain_rejects.collect())
    assert [r[:2] for r in rows] == [("p", "row"), ("p", "row"), ("q", "file"), ("r", "file")]
    assert {r[2] for r in rows} == {"7", '{"created":"never","sessionId":"b"}', None}
    assert [(r.session_id, r.entry_idx, r.project_path, r.summary) for r in entries.collect()] == [("a", 0, "/o", "s")]


def test_small_files_share_batches(tmp_path):
    one = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([b"x" * 1000])], names=["i", "value"]) for i in range(5000)]
    got = list(R.merged(iter(one)))
    assert len(got) < 10 and [i for b in got for i in b.column("i").to_pylist()] == list(range(5000))
    assert list(R.merged(iter([]))) == []

"""Files that are still being written, as a stream.

Spark's file source reads a file once and does not come back when it grows. This source keeps an offset per
file: a trigger lists the folder, reads what each file has gained up to its last finished line, and leaves a
half-written line for the next one. A file that was replaced, by a shorter or a longer one, is
read again from its start. Offsets are part of the query's checkpoint, so a restart goes on where it ended.

Small files share a task: ranges are packed by their bytes, and opening a file counts as some. An offset has one
small entry per file of the folder (path below it, time, size, and where, by what and how often it was read, about
100 bytes): keep files that are finished for good elsewhere.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators import records
from tracewell.session import configure, importable
from tracewell.sources import ranges, storage
from tracewell.sources.listing import walk

NAME = "growing_lines"


OPENERS = 16
HEAD_DIGITS = 32  # of a fingerprint, in an offset


class Seen(NamedTuple):
    """What an offset tells of a file: as it was listed, where its last finished line ends, its first bytes, and how often it was replaced."""

    mtime_ms: int
    size: int
    end: int = 0
    head_bytes: int = 0
    head: str = ""
    turn: int = 0


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads: (path, mtime_ms, start, stop, end) each."""

    ranges: list[tuple[str, int, int, int, int]]


class GrowingLines(DataSource):
    """Options: path, pattern (of file names), split_bytes, tasks (among which small inputs are dealt), universal (whether a carriage return ends a line)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ranges.LINES

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.split_bytes = int(options.get("split_bytes", ranges.SPLIT_BYTES))
        self.tasks = int(options.get("tasks", "1"))
        self.how = ranges.Lines(options.get("universal", "true") == "true", unfinished=False)
        self.known: dict[str, Seen] = {}

    def initialOffset(self) -> dict:
        return {}

    def _name(self, path: str) -> str:
        return path.removeprefix(self.listed_root() + "/")

    def listed_root(self) -> str:
        """How listed paths begin."""
        _, inner, before = storage.opened(self.root)
        return before + inner

    def _entries(self, offset: dict) -> dict[str, Seen]:
        """An offset's entries; those of older checkpoints have whole paths and named fields."""
        return {self._name(path): Seen(**entry) if isinstance(entry, dict) else Seen(*entry) for path, entry in offset.items()}

    def _seen(self, path: str, mtime_ms: int, size: int, old: Seen) -> Seen:
        system, inner, _ = storage.opened(path)
        with system.open_input_file(inner) as stream:
            found = ranges.place(stream, size, old.end, old.head_bytes, old.head or None)
        return Seen(mtime_ms, size, found.complete, found.head_bytes, found.head[:HEAD_DIGITS], old.turn + int(found.replaced))

    def latestOffset(self) -> dict:
        out, touched = {}, []
        above = len(self.listed_root()) + 1
        for path, _, mtime_ms, size in walk(self.root, self.root, True, entries=2**62):
            if not fnmatch.fnmatch(path.rsplit("/", 1)[1], self.pattern):
                continue
            old = self.known.get(path[above:])
            if old and (old.mtime_ms, old.size) == (mtime_ms, size):
                out[path[above:]] = old  # not touched since: not opened
            else:
                touched.append((path, mtime_ms, size, old or Seen(0, 0)))
        with ThreadPoolExecutor(OPENERS) as pool:
            for (path, *_), seen in zip(touched, pool.map(lambda file: self._seen(*file), touched)):
                out[path[above:]] = seen
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        start, end = self._entries(start), self._entries(end)
        # after a restart the checkpointed offset tells what was there
        self.known = self.known or end
        above, todo = self.listed_root(), []
        for name, now in sorted(end.items()):
            old = start.get(name)
            at = old.end if old and old.turn == now.turn else 0
            while at < now.end:
                stop = min(at + self.split_bytes, now.end)
                todo.append((f"{above}/{name}", now.mtime_ms, at, stop, now.end))
                at = stop
        cost = [stop - at + ranges.OPEN_BYTES for _, _, at, stop, _ in todo]
        most = min(max(self.split_bytes, ranges.OPEN_BYTES), -(-sum(cost) // self.tasks))
        out, room = [], 0
        for piece, size in zip(todo, cost):
            if not out or size > room:
                out.append(Ranges([]))
                room = most
            out[-1].ranges.append(piece)
            room -= size
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        pieces = (batch for path, mtime_ms, start, stop, end in partition.ranges for batch in ranges.line_batches(path, mtime_ms, end, start, stop, self.how))
        yield from ranges.merged(pieces)


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl", **options: str) -> DataFrame:
    """A stream of the lines that files gain, each once; (block_start, line_id) orders the lines of a file."""
    storage.opened(folder)  # a path that cannot be opened fails here
    importable(spark).dataSource.register(GrowingLines)
    stream = spark.readStream.format(NAME).option("pattern", pattern).option("tasks", spark.sparkContext.defaultParallelism)
    for key, value in options.items():
        stream = stream.option(key, value)
    return stream.load(folder).withColumn("value", F.col("value").cast("string"))


def start_growing(
    spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True, interval: str = "1 minute", **options: str
) -> StreamingQuery:
    """Parse what transcripts gain into `out`, one folder per micro-batch: a batch that is run again replaces its own."""

    def load(lines: DataFrame, batch: int) -> None:
        records.parse_records(lines).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch}")

    stream = growing_lines(configure(spark), folder, **options)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

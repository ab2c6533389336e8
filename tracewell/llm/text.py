"""Cutting Arrow batches and whole texts into words, a slice of a few megabytes at a time."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import scratch_dir

SLICE_BYTES = 4 << 20

#: A-Z to a-z; digits, letters and all bytes of other characters stay; the rest separates words.
LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words are what ASCII white space leaves.
SPACED_WORDS = bytes(32 if c in b" \t\n\v\f\r" else c for c in range(256))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def split_words(texts: pa.Array, table: bytes = LOWER_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts on end: their bytes, the offsets of each word in them, and where each text's words begin and end.

    `table` maps separators to a blank and other bytes to what they count as. Null has no words.
    """
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    data = np.frombuffer(data.tobytes().translate(table), np.uint8)
    kept = data != 32
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = kept[begins]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, at)
    rank = np.cumsum(kept)
    offsets = np.empty(len(starts) + 1, np.int64)
    offsets[:-1] = rank[starts] - 1
    offsets[-1] = rank[-1] if len(rank) else 0
    return data[kept], offsets, bounds


def word_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits per word, the same in every process: a polynomial in its bytes, mixed."""
    if len(offsets) < 2:
        return np.empty(0, np.uint64)
    lengths = np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], offsets[:-1]))


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """The same rows, written once to the shared scratch folder: cuts the lineage, so a lost executor costs only its tasks."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashes(df: DataFrame, at: str, rows: int) -> DataFrame:
    """About `rows` rows of `df`, those with the least values of the hash column `at` (evenly spread 64 bits); all, if there are no more.

    Decided row by row from one count, so nothing is gathered, unlike an ordered limit, which sends that many rows per partition.
    """
    return df.where(F.col(at) <= hash_bound(df.count(), rows))


def hash_bound(count: int, rows: int) -> int:
    """The value that about `rows` of `count` evenly spread 64-bit hashes do not exceed."""
    return min(int(-(2**63) + min(1.0, rows / max(count, 1)) * 2**64), 2**63 - 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid4().hex[:8]}" for n in names]


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package, wherever the driver was started from.

    On a cluster the package is installed or sent with --py-files, as for any job.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])
    return spark

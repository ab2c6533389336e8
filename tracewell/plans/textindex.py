"""Substring search that reads only what can match: character trigrams of texts, per shard of rows.

`build` writes the rows in shards of bounded size and, sorted by trigram, which shards hold it. A search folds the
query as the match itself does, looks up the trigrams of its literal pieces, keeps the shards that hold all of
them and reads only these; the report's own condition then decides row by row. Queries without three literal
characters in a row read every shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import importable

SHARD_BYTES = 64 << 20


def grams_of(query: str, literal: bool) -> set[str]:
    """Trigrams that every match of a folded query holds; % and _ are wildcards unless it is literal."""
    pieces = [query] if literal else re.split("[%_]", query)
    return {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, *texts: str, shard_bytes: int = SHARD_BYTES) -> TextIndex:
        """Index the columns `texts` of some rows; what was there is replaced."""
        size = rows.agg(sum(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts)).first()[0]
        shards = max(1, -(-size // shard_bytes))
        numbered = rows.repartition(shards).withColumn("shard", F.spark_partition_id())
        numbered.write.mode("overwrite").partitionBy("shard").parquet(f"{self.root}/rows")
        importable(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[int, set[str]] = {}
                shard = batch.column("shard").to_pylist()
                for column in batch.columns[1:]:
                    for k, text in zip(shard, column.to_pylist()):
                        if text:
                            held.setdefault(k, set()).update(text[i : i + 3] for i in range(len(text) - 2))
                rows = [(g, k) for k, grams in held.items() for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["gram", "shard"])

        folded = self.rows().select(F.col("shard").cast("int").alias("shard"), *(F.lower(c).alias(f"t{i}") for i, c in enumerate(texts)))
        grams = folded.mapInArrow(run, "gram string, shard int").distinct()
        grams.repartitionByRange("gram").sortWithinPartitions("gram", "shard").write.mode("overwrite").parquet(f"{self.root}/grams")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def shards_for(self, query: str, literal: bool = False) -> list[int] | None:
        """Shards that can hold a match; None: all."""
        folded = self.spark.range(1).select(F.lower(F.lit(query))).first()[0]
        grams = sorted(grams_of(folded, literal))
        if not grams:
            return None
        held = self.spark.read.parquet(f"{self.root}/grams").where(F.col("gram").isin(grams))
        full = held.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        return sorted(r.shard for r in full.collect())  # numbers of shards, not rows

    def candidates(self, query: str, literal: bool = False) -> DataFrame:
        """The rows of those shards; folders of other shards are not opened."""
        shards = self.shards_for(query, literal)
        rows = self.rows()
        return (rows if shards is None else rows.where(F.col("shard").isin(shards))).drop("shard")

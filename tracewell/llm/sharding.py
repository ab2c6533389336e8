"""Sharding by minimax contiguous partition, in DataFrame operations only.

Equal texts are one atomic group; groups lie in one order: by size, largest first, then by digest. The order is
cut into contiguous shards such that the largest shard is as small as possible: binary search for the smallest
capacity with which a greedy pass needs no more shards than there are, then cut where that pass cuts. With
the largest groups first, cuts fall among small groups, so that sizes come out near equal.
A group that alone exceeds the mean of what is left gets a shard of its own, and the rest is solved without it.

Groups of one size are a run; runs are few: their sizes differ, so T bytes make at most sqrt(2 T) of them. A
greedy pass is one aggregation over the runs per shard, for 31 capacities at a time (five
halvings). Positions inside a run are only worked out for the runs that a cut goes through. All ranks come from
counts per hash bucket plus a window inside a bucket, so no shard, size or text meets in one task.

Null text counts as empty (size 1). doc_id may repeat or be null: rows are what is dealt out. With fewer groups than
shards some shards stay empty. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.text import written

SHARDS = 8
PROBES = 31
BUCKETS = 1024


def _running(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows before, per `by`, ordered by bucket (0 to some thousand at most), then `order`."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = df.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, [*by, "_bucket"])
        .withColumn(name, (F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("bigint"))
        .drop("_bucket", "_value", "_before")
    )


def _runs(groups: DataFrame) -> DataFrame:
    """(bytes, n, start): groups of equal size, largest first, and the bytes before them."""
    runs = groups.groupBy(F.col("group_bytes").alias("bytes")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    # 64 buckets per doubling of the size: at most 4032 of them, and in the order of the sizes
    bucket = F.lit(4032) - F.floor(F.log2("bytes") * 64)
    return written(_running(runs, ["one"], bucket, [F.col("bytes").desc()], F.col("bytes") * F.col("n"), "start").drop("one"), "shard-runs")


def _greedy(runs: DataFrame, start: int, shards: int, capacities: list[int], total: int) -> list[list[int]]:
    """Per capacity the cuts of a greedy pass from `start`: ends of the shards, as bytes of the order."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        ends = [(c[-1] if c else start) + capacity for c, capacity in zip(cuts, capacities)]
        reach = [
            F.max(F.when(F.col("start") <= end, F.col("start") + F.col("bytes") * F.least(F.col("n"), F.floor((F.lit(end) - F.col("start")) / F.col("bytes")))))
            for end in ends
        ]
        row = runs.agg(*(r.alias(f"r{i}") for i, r in enumerate(reach))).first()
        for c, end in zip(cuts, row):
            c.append(min(end, total))
        if all(c[-1] >= total for c in cuts):
            break
    return cuts


def minimax_cuts(runs: DataFrame, shards: int) -> list[int]:
    """Ends of the shards (at most `shards` of them), as bytes of the order."""
    head = runs.agg(F.sum(F.col("bytes") * F.col("n")).alias("total")).first()
    total, at = head["total"] or 0, 0
    alone: list[int] = []
    # atomic groups above the mean of the rest: at most one per shard
    top = runs.orderBy(F.desc("bytes")).limit(shards).collect()
    for size in [r["bytes"] for r in top for _ in range(min(r["n"], shards))]:
        left = shards - len(alone)
        if left <= 1 or size * left <= total - at:
            break
        at += size
        alone.append(at)
    shards -= len(alone)
    if total == at:
        return alone
    largest = runs.where(F.col("start") + F.col("bytes") * F.col("n") > at).agg(F.max("bytes")).first()[0]
    low, high = max(-(-(total - at) // shards), largest) - 1, -(-(total - at) // shards) + largest  # low fails, high holds
    while high - low > 1:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        tried = list(range(low + step, high, step))
        fits = [c[-1] >= total for c in _greedy(runs, at, shards, tried, total)]
        first = fits.index(True) if True in fits else len(tried)
        low, high = ([low] + tried)[first], (tried + [high])[first]
    ends = _greedy(runs, at, shards, [high], total)[0]
    return alone + ends


def minimax_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce("text", F.lit(""))
    narrow = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")),
        "shard-documents",
    )
    groups = written(narrow.groupBy("key", "size").agg((F.count("*") * F.col("size")).alias("group_bytes")), "shard-groups")
    runs = _runs(groups)
    cuts = minimax_cuts(runs, shards)
    inner = cuts[:-1]
    crossed = runs.where(F.lit(False))
    for c in inner:
        crossed = crossed.unionByName(runs.where((F.col("start") < c) & (F.col("start") + F.col("bytes") * F.col("n") > c)))
    crossed = crossed.distinct()

    def shard(position: Column) -> Column:
        return sum((F.when(position >= c, 1).otherwise(0) for c in inner), F.lit(0)).cast("int")

    whole = groups.join(runs.join(crossed.select("bytes"), "bytes", "left_anti"), F.col("group_bytes") == F.col("bytes"))
    whole = whole.select("key", shard(F.col("start")).alias("shard"))
    # runs that a cut goes through: at most one per cut
    parts = groups.join(F.broadcast(crossed.select("bytes", "start")), F.col("group_bytes") == F.col("bytes")).select("key", "bytes", "start")
    parts = _running(parts, ["bytes"], F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int"), [F.col("key")], F.col("bytes"), "offset")
    parts = parts.select("key", shard(F.col("start") + F.col("offset")).alias("shard"))
    placed = narrow.join(written(whole.unionByName(parts), "shard-places"), "key")
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS))
    return _running(placed, ["shard"], bucket, [F.col("doc_id"), F.col("key")], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = minimax_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Totals kept up to date batch by batch, so that reports need not read the sessions again.

`SessionTotals` holds, per batch, what changed per (day, project): a session that was replaced takes its old values
back and adds its new ones. Days that a batch does not touch are not written. `DailyDistinct` holds which sessions
were seen per (day, name) as bitmaps over dense numbers of sessions: or-ed over any range of days they give exact
distinct counts without a look at the rows. A batch that is run again replaces its own part.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.sources import files

#: name of a sum -> column of the sessions; sessions themselves are counted
SUMS = {
    "sessions": None,
    "messages": "message_count",
    "input_tok": "total_input_tokens",
    "output_tok": "total_output_tokens",
    "cache_read": "total_cache_read",
    "cache_write": "total_cache_write",
}
NUMBERING_PARTS = 64


class SessionTotals:
    """Sums of sessions per (day, project_name)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/session_totals"

    def apply(self, batch: int, before: DataFrame, after: DataFrame) -> None:
        """Sessions in their versions before (those replaced) and after (those replaced or new) a batch."""
        signed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)), allowMissingColumns=True)
        changes = signed.groupBy(F.to_date("created_at").alias("day"), "project_name").agg(*(F.sum(F.col("sign") * F.col(c) if c else F.col("sign")).alias(n) for n, c in SUMS.items()))
        some = F.array(*(F.col(n) for n in SUMS))
        changes.where(F.exists(some, lambda v: v != 0)).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch}")

    def table(self, since: dt.date | None = None) -> DataFrame:
        """Current sums per (day, project_name)."""
        parts = self.spark.read.parquet(self.path)
        if since is not None:
            parts = parts.where(F.col("day") >= F.lit(since))
        return parts.groupBy("day", "project_name").agg(*(F.sum(n).alias(n) for n in SUMS)).where("sessions > 0")

    def _by_project(self, as_of: dt.date, days: int) -> DataFrame:
        since = as_of - dt.timedelta(days=days)
        return self.table(since).groupBy("project_name").agg(*(F.sum(n).alias(n) for n in SUMS))

    def tokens_by_project(self, as_of: dt.date, days: int = 7, limit: int = 30) -> DataFrame:
        sums = self._by_project(as_of, days).drop("messages").withColumn("total", F.col("input_tok") + F.col("output_tok"))
        return sums.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("project_name")).limit(limit)

    def cost_by_project(self, as_of: dt.date, days: int = 30, limit: int = 10) -> DataFrame:
        sums = self._by_project(as_of, days)
        share = S.ratio_round(F.col("cache_read"), F.col("input_tok") + F.col("cache_read"), digits=1, percent=True)
        costs = sums.select("project_name", "sessions", "input_tok", "output_tok", "cache_read", share.alias("cache_hit_pct"), _cost().alias("est_cost_usd"))
        return costs.orderBy(F.desc_nulls_last("est_cost_usd"), F.asc_nulls_last("project_name")).limit(limit)

    def daily_activity(self, as_of: dt.date, days: int = 14) -> DataFrame:
        sums = self.table(as_of - dt.timedelta(days=days)).groupBy("day")
        return sums.agg(F.sum("sessions").alias("sessions"), F.sum("messages").alias("msgs")).orderBy("day")


def _cost() -> Column:
    return S.usd(S.cost_nano(F.col("input_tok"), F.col("output_tok")))


class DailyDistinct:
    """Rows and distinct sessions per (day, name), for any range of days."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> DataFrame:
        return files.or_empty(lambda: self.spark.read.parquet(f"{self.root}/numbers"), self.spark, "session_id string, number bigint, batch_id int")

    def apply(self, batch: int, rows: DataFrame) -> None:
        """Rows with name, session_id and timestamp; sessions not seen before get the next numbers."""
        known = self._numbers().where(F.col("batch_id") < batch)
        new = rows.select("session_id").where(F.col("session_id").isNotNull()).distinct().join(known, "session_id", "left_anti")
        parted = new.withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(NUMBERING_PARTS)))
        place = F.row_number().over(Window.partitionBy("part").orderBy("session_id"))
        first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        # a row per part, of which there are a fixed number
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = parted.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + first).alias("base"))
        numbered = parted.withColumn("place", place).join(bases, "part").select("session_id", (F.col("base") + F.col("place") - 1).alias("number"))
        numbered.write.mode("overwrite").parquet(f"{self.root}/numbers/batch_id={batch}")
        numbers = self._numbers().where(F.col("batch_id") <= batch).select("session_id", "number")
        seen = rows.select("name", "session_id", F.to_date("timestamp").alias("day")).groupBy("name", "day", "session_id").agg(F.count("*").alias("rows"))
        bits = seen.join(numbers, "session_id", "left").groupBy("name", "day", F.bitmap_bucket_number("number").alias("bucket"))
        bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.sum("rows").alias("rows")).write.mode("overwrite").parquet(
            f"{self.root}/bits/batch_id={batch}"
        )

    def between(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """name, rows, sessions (exact), first and last day, over days from `first` to `last`."""
        bits = self.spark.read.parquet(f"{self.root}/bits")
        for bound, day in ((F.col("day") >= F.lit(first), first), (F.col("day") <= F.lit(last), last)):
            bits = bits if day is None else bits.where(bound)
        merged = bits.groupBy("name", "bucket").agg(
            F.bitmap_count(F.bitmap_or_agg("bits")).alias("sessions"), F.sum("rows").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last")
        )
        return merged.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("sessions").alias("sessions"), F.min("first").alias("first"), F.max("last").alias("last"))

"""Rolling reports on a stream of messages or tool calls, in windows of event time.

A micro-batch adds its sums per window (and session) to a table of partial sums; windows that it touches are
restated from all partial sums and replace their old rows. So a row counts whenever it comes: nothing is dropped
behind a watermark, distinct sessions are exact, and no state is kept beyond the tables. Rows that come
later than the delay after the newest row seen before are counted as late, per window.

Tables below ``out``: ``partials`` (batch_id, window), ``marks`` (newest time per batch), ``windows`` (the report).
A batch that is run again replaces its own partial sums and states its windows anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import constants as C
from tracewell.functions import scalars as S
from tracewell.sources import files


@dataclass(frozen=True)
class Rollup:
    """A report by windows: where a row's window begins, what is summed, and the report from the sums."""

    window: Column
    length: str
    sums: dict[str, Column]
    keys: tuple[str, ...]  # columns whose distinct values are counted, kept beside the sums
    report: Callable[[DataFrame], DataFrame]


def daily_messages() -> Rollup:
    """Per day: messages, tokens, sessions (exact) and rows that came late."""

    def report(partials: DataFrame) -> DataFrame:
        totals = [F.sum(c).alias(c) for c in ("messages", "input_tok", "output_tok")]
        return partials.groupBy(F.col("window").alias("day")).agg(
            *totals, F.countDistinct("session_id").alias("sessions"), F.sum("late").alias("late")
        )

    sums = {
        "messages": F.count("*"),
        "input_tok": F.coalesce(F.sum("input_tokens"), F.lit(0)),
        "output_tok": F.coalesce(F.sum("output_tokens"), F.lit(0)),
    }
    return Rollup(F.to_date("timestamp"), "1 day", sums, ("session_id",), report)


def weekly_write_read(writes: Sequence[str] = C.WRITE_TOOLS, reads: Sequence[str] = C.READ_TOOLS) -> Rollup:
    """Per week, from Monday: calls that write and that read, their ratio, and rows that came late."""

    def report(partials: DataFrame) -> DataFrame:
        sums = partials.groupBy(F.col("window").alias("week")).agg(*(F.sum(c).alias(c) for c in ("writes", "reads", "late")))
        ratio = S.ratio_round(F.col("writes"), F.col("reads"), 2)
        return sums.select("week", "writes", "reads", ratio.alias("write_read_ratio"), "late")

    sums = {"writes": F.count_if(F.col("tool_name").isin(*writes)), "reads": F.count_if(F.col("tool_name").isin(*reads))}
    return Rollup(F.to_date(F.date_trunc("week", "timestamp")), "7 days", sums, (), report)


def add_batch(rows: DataFrame, batch: int, out: str, rollup: Rollup, delay: str = "1 day") -> None:
    """Add one micro-batch. Rows without a time belong to no window."""
    spark, out = rows.sparkSession, out.rstrip("/")
    marks = files.or_empty(lambda: spark.read.parquet(f"{out}/marks"), spark, "newest timestamp, batch_id int")
    newest = marks.where(F.col("batch_id") < batch).agg(F.max("newest")).first()[0]
    window_end = F.col("window").cast("timestamp") + F.expr(f"INTERVAL {rollup.length}")
    late = F.lit(False) if newest is None else window_end <= F.lit(newest) - F.expr(f"INTERVAL {delay}")
    timed = rows.where(F.col("timestamp").isNotNull()).withColumn("window", rollup.window)
    sums = timed.groupBy("window", *rollup.keys).agg(
        *(c.alias(name) for name, c in rollup.sums.items()), F.count_if(late).alias("late"), F.max("timestamp").alias("newest")
    )
    path = f"{out}/partials/batch_id={batch}"
    sums.write.mode("overwrite").partitionBy("window").parquet(path)
    mine = spark.read.schema(sums.schema).parquet(path)
    mine.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch}")
    # only the folders of touched windows are read again and replaced; their number is bounded by the calendar
    touched = [r.window for r in mine.select("window").distinct().collect()]
    kept = spark.read.schema(f"{sums.schema.toDDL()}, batch_id INT").parquet(f"{out}/partials")
    report = rollup.report(kept.where((F.col("batch_id") <= batch) & F.col("window").isin(touched)))
    by = report.columns[0]
    report.withColumn("window", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(f"{out}/windows")


def report_of(spark: SparkSession, out: str) -> DataFrame:
    """The report as last stated: one row per window."""
    return spark.read.parquet(f"{out.rstrip('/')}/windows").drop("window")


def start_rollup(
    stream: DataFrame, out: str, checkpoint: str, rollup: Rollup, delay: str = "1 day", available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Keep a report up to date with a stream that has a column ``timestamp``."""
    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch: add_batch(rows, batch, out, rollup, delay))
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

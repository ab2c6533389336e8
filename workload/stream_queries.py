"""Streaming reports over the events, which arrive in two steps: most at first, the rest late, from all times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import scratch_dir
from tracewell.streaming import rollups
from workload.derived import table
from workload.report_queries import READS, WRITES
from workload.report_sql import MSG, ratio

LATE_EVERY = 10  # every tenth event arrives in the second step


def event_messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("tool_name"),
        F.floor(F.col("value") * 100).alias("input_tokens"),
        F.floor(F.col("value") * 10).alias("output_tokens"),
    )


def arrived(spark: SparkSession, sf: str, rollup: rollups.Rollup) -> DataFrame:
    """The report after both steps, each drained by the same query, restarted from its checkpoint."""
    folder, out, checkpoint = (scratch_dir(spark, name) for name in ("events", "windows", "checkpoint"))
    rows = event_messages(spark, sf)
    late = F.col("event_id") % LATE_EVERY == 0
    for step, part in enumerate((rows.where(~late), rows.where(late))):
        part.write.parquet(f"{folder}/step={step}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/step=*")
        rollups.start_rollup(stream, out, checkpoint, rollup).awaitTermination()
    return rollups.report_of(spark, out)


QUERIES = {
    "s01_daily_messages": lambda spark, sf: arrived(spark, sf, rollups.daily_messages()),
    "s02_weekly_write_read": lambda spark, sf: arrived(spark, sf, rollups.weekly_write_read(WRITES, READS)),
}

_W, _R = "count(*) FILTER (WHERE tool_name IN ('signup', 'purchase'))", "count(*) FILTER (WHERE tool_name = 'view')"


def _late(window: str, days: int) -> str:
    """Rows of the second step whose window had ended more than a day before the newest row of the first."""
    newest = f"(SELECT max(ts) FROM events WHERE event_id % {LATE_EVERY} <> 0)"
    return f"count(*) FILTER (WHERE event_id % {LATE_EVERY} = 0 AND {window} + INTERVAL {days} DAY <= {newest} - INTERVAL 1 DAY)"


_DAY, _WEEK = "CAST(timestamp AS DATE)", "CAST(date_trunc('week', timestamp) AS DATE)"
ORACLE = {
    "s01_daily_messages": f"""WITH {MSG} SELECT {_DAY} AS day, count(*) AS messages,
      CAST(sum(input_tokens) AS BIGINT) AS input_tok, CAST(sum(output_tokens) AS BIGINT) AS output_tok,
      count(DISTINCT split_part(session_id, '-', 1)) AS sessions, {_late(_DAY, 1)} AS late
      FROM w_msg GROUP BY 1""",
    "s02_weekly_write_read": f"""WITH {MSG} SELECT {_WEEK} AS week, {_W} AS writes,
      {_R} AS reads, {ratio(_W, _R, 2)} AS write_read_ratio, {_late(_WEEK, 7)} AS late FROM w_msg GROUP BY 1""",
}

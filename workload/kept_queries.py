"""Reports from totals, bitmaps and text indexes that are kept beside the tables, equal to the reports over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import reports as R
from tracewell.plans.textindex import TextIndex
from tracewell.plans.totals import DailyDistinct, SessionTotals
from tracewell.session import scratch_dir
from workload import derived as D
from workload.report_queries import ACCENT, PATTERN, WORD
from workload.report_sql import ORACLE as REPORTS

BATCHES = 3  # events arrive in turn, so sessions grow from batch to batch


def totals(spark: SparkSession, sf: str) -> SessionTotals:
    kept, events = SessionTotals(spark, scratch_dir(spark, "totals")), D.event_messages(spark, sf)
    turn = F.col("event_id") % BATCHES
    for batch in range(BATCHES):
        touched = events.where(turn == batch).select("session_id").distinct()
        before, after = (D.event_sessions(spark, sf, events=events.where(turn < n)).join(touched, "session_id", "left_semi") for n in (batch, batch + 1))
        kept.apply(batch, before, after)
    return kept


def distinct(spark: SparkSession, sf: str) -> DailyDistinct:
    kept, events = DailyDistinct(spark, scratch_dir(spark, "distinct")), D.event_messages(spark, sf)
    for batch in range(BATCHES):
        kept.apply(batch, events.where(F.col("event_id") % BATCHES == batch).withColumnRenamed("tool_name", "name"))
    return kept


def tool_usage(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    found = distinct(spark, sf).between(D.AS_OF - dt.timedelta(days=days))
    return found.select(F.col("name").alias("tool_name"), F.col("rows").alias("calls"), "sessions")


def hook_summary(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    found = distinct(spark, sf).between(D.AS_OF - dt.timedelta(days=days))
    return found.select(F.col("name").alias("event_type"), F.col("rows").alias("events"), "sessions", "first", "last")


def search(query: str, literal: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index = TextIndex(spark, scratch_dir(spark, "index")).build(D.conversation_messages(spark, sf), "text_content")
        return R.search_messages(index.candidates(query, literal), D.conversation_sessions(spark, sf), query, literal=literal)

    return run


def search_history(spark: SparkSession, sf: str) -> DataFrame:
    index = TextIndex(spark, scratch_dir(spark, "index")).build(D.document_history(spark, sf), "content", "description")
    return R.search_history(index.candidates(WORD), WORD)


QUERIES = {
    "r01_kept_tokens_by_project": lambda spark, sf: totals(spark, sf).tokens_by_project(D.AS_OF),
    "r13_kept_cost_by_project": lambda spark, sf: totals(spark, sf).cost_by_project(D.AS_OF),
    "r15_kept_daily_activity": lambda spark, sf: totals(spark, sf).daily_activity(D.AS_OF),
    "r02_kept_tool_usage": tool_usage,
    "r08_kept_hook_summary": hook_summary,
    "r04_indexed_search": search(WORD),
    "r04_indexed_wildcard": search(PATTERN),
    "r04_indexed_literal": search(ACCENT, literal=True),
    "r05_indexed_search_history": search_history,
}

ORACLE = {
    "r01_kept_tokens_by_project": REPORTS["r01_tokens_by_project"],
    "r13_kept_cost_by_project": REPORTS["r13_cost_by_project"],
    "r15_kept_daily_activity": REPORTS["r15_daily_activity"],
    "r02_kept_tool_usage": REPORTS["r02_tool_usage"],
    "r08_kept_hook_summary": REPORTS["r08_hook_summary"],
    "r04_indexed_search": REPORTS["r04_search_messages"],
    "r04_indexed_wildcard": REPORTS["r04_search_messages_wildcard"],
    "r04_indexed_literal": REPORTS["r04_search_messages_literal"],
    "r05_indexed_search_history": REPORTS["r05_search_history"],
}

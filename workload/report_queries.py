"""Report queries over the derived tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.plans import insights as I
from tracewell.plans import reports as R
from workload import derived as D

LO, HI = dt.date(2024, 1, 8), dt.date(2024, 1, 22)
WRITES, READS = ("signup", "purchase"), ("view",)
TYPES = {"view": "The Scholar", "purchase": "The Surgeon", "click": "The Hacker"}

WORD, PATTERN, ACCENT = "ment", "l_ m%t", "ÉON"


def _s(fn, prompts=False):
    return lambda spark, sf: fn(D.event_sessions(spark, sf, prompts))


def _t(fn):
    return lambda spark, sf: fn(D.event_messages(spark, sf))


def _ts(fn):
    return lambda spark, sf: fn(D.event_messages(spark, sf), D.event_sessions(spark, sf))


def _search(query, literal=False):
    return lambda spark, sf: R.search_messages(
        D.conversation_messages(spark, sf), D.conversation_sessions(spark, sf), query, literal=literal
    )


def _tables(spark, sf):
    events = D.event_messages(spark, sf)
    return {
        "sessions": D.event_sessions(spark, sf),
        "messages": events,
        "tool_calls": events.select("session_id", F.col("uuid").alias("message_uuid"), "tool_name", "timestamp"),
        "hook_events": D.event_hooks(spark, sf),
        "research_history": D.document_history(spark, sf),
    }


RAW_SQL = """
    SELECT t.tool_name, s.project_name, count(*) AS calls, count(DISTINCT t.session_id) AS sessions
    FROM tool_calls t JOIN sessions s ON t.session_id = s.session_id
    WHERE s.message_count > 3
    GROUP BY t.tool_name, s.project_name
"""


def _state(spark, sf):
    """A sync state as each project's events would leave it."""
    return D.event_messages(spark, sf).groupBy(F.col("project_name").alias("source_name")).agg(
        F.max("timestamp").alias("last_run"),
        F.countDistinct("session_id").alias("files_synced"),
        F.count("*").alias("rows_synced"),
    )


def _display(s):
    counts = s.select(
        "session_id",
        S.human_count(F.col("total_input_tokens")).alias("terminal"),
        S.human_count(F.col("total_input_tokens"), ties="up").alias("web"),
        S.money(S.usd(S.cost_nano(F.col("total_input_tokens"), F.col("total_output_tokens")))).alias("cost"),
        S.clean_label(F.concat(F.lit("-"), F.col("session_id"), F.lit("-"), F.col("project_name"))).alias("label"),
    )
    return counts


QUERIES = {
    "r01_tokens_by_project": _s(lambda s: R.tokens_by_project(s, D.AS_OF)),
    "r01_tokens_grand_total": _s(lambda s: R.tokens_grand_total(R.tokens_by_project(s, D.AS_OF, limit=5))),
    "r02_tool_usage": _t(lambda t: R.tool_usage(t, D.AS_OF)),
    "r02_tool_counts_week": _t(lambda t: R.tool_counts(t, D.AS_OF)),
    "r03_recent_sessions": _s(R.recent_sessions, prompts=True),
    "r03_recent_sessions_with_cost": _s(R.recent_sessions_with_cost, prompts=True),
    "r04_search_messages": _search(WORD),
    "r04_search_messages_wildcard": _search(PATTERN),
    "r04_search_messages_literal": _search(ACCENT, literal=True),
    "r05_search_history": lambda spark, sf: R.search_history(D.document_history(spark, sf), WORD),
    "r06_project_summary": _s(R.project_summary),
    "r07_table_stats": lambda spark, sf: R.table_stats(_tables(spark, sf)),
    "r07_sync_status": lambda spark, sf: R.sync_status(_state(spark, sf)),
    "r08_hook_summary": lambda spark, sf: R.hook_summary(D.event_hooks(spark, sf), D.AS_OF),
    "r09_raw_sql": lambda spark, sf: R.sql(spark, RAW_SQL, _tables(spark, sf)),
    "r10_overview": _s(lambda s: R.overview(s, D.AS_OF)),
    "r10_overview_half_month": _s(lambda s: R.overview(s, D.AS_OF, days=15)),
    "r11_overview_delta": _s(lambda s: R.overview_delta(R.overview(s, D.AS_OF, days=15))),
    "r12_last_sync": lambda spark, sf: R.last_sync(_state(spark, sf)),
    "r13_cost_by_project": _s(lambda s: R.cost_by_project(s, D.AS_OF)),
    "r13_cost_and_cache_by_project": _s(lambda s: R.cost_and_cache_by_project(s, D.AS_OF)),
    "r14_tool_share": _t(lambda t: R.tool_share(t, D.AS_OF, limit=3)),
    "r15_daily_activity": _s(lambda s: R.daily_activity(s, D.AS_OF)),
    "r16_write_read_ratio": _t(lambda t: R.write_read_ratio(t, 8, WRITES, READS)),
    "r16_edit_read_ratio": _t(lambda t: R.write_read_ratio(t, 12, WRITES[:1], READS, newest_first=True)),
    "r17_session_buckets": _s(lambda s: R.session_buckets(s, D.AS_OF)),
    "r17_session_buckets_long_labels": _s(lambda s: R.session_buckets(s, D.AS_OF, labels=S.MESSAGE_LABELS_LONG)),
    "r18_prompt_quality": _s(lambda s: R.prompt_quality(s, D.AS_OF), prompts=True),
    "r18_prompt_quality_long_labels": _s(
        lambda s: R.prompt_quality(s, D.AS_OF, labels=S.PROMPT_LABELS_LONG, cost=False), prompts=True
    ),
    "r19_longest_streak": _s(R.longest_streak),
    "r19_longest_streak_by_project": _s(lambda s: R.longest_streak(s, by="project_name")),
    "r20_peak_hours": _s(R.peak_hours),
    "r21_marathon": _s(R.marathon, prompts=True),
    "r22_all_time": _s(R.all_time),
    "r23_developer_type": _t(lambda t: R.developer_type(t, TYPES)),
    "r24_weekly_spend": _s(R.weekly_spend),
    "r25_costliest_sessions": _s(R.costliest_sessions, prompts=True),
    "r26_abandoned_costly": _s(R.abandoned_costly, prompts=True),
    "r26_abandoned_by_tokens": _s(R.abandoned_by_tokens, prompts=True),
    "r27_cache_savings": _s(lambda s: R.cache_savings(s, D.AS_OF)),
    "r28_top_projects": _s(R.top_projects),
    "r29_favourite_tools": _t(R.favourite_tools),
    "r30_biggest_session": _s(R.biggest_session, prompts=True),
    "r31_busiest_day": _s(R.busiest_day),
    "r32_model_usage": _t(R.model_usage),
    "r33_worklog": _s(lambda s: R.worklog(s, D.AS_OF)),
    "r33_worklog_tokens": _s(lambda s: R.worklog(s, D.AS_OF, tokens=True)),
    "r34_prompt_len_vs_tokens": _s(R.prompt_len_vs_tokens, prompts=True),
    "r35_daily_spend": _s(R.daily_spend),
    "r36_find_sessions": lambda spark, sf: R.find_sessions(D.conversation_sessions(spark, sf), "OJ_1"),
    "r37_tools_in_range": _ts(lambda t, s: R.tools_in_range(t, s, LO, HI)),
    "r38_models_in_range": _ts(lambda m, s: R.models_in_range(m, s, LO, HI)),
    "d01_cost_by_model": _t(I.cost_by_model),
    "d02_top_prompts": _s(I.top_prompts, prompts=True),
    "d03_spend_trend": _s(I.spend_trend),
    "d04_month_spend": _s(lambda s: I.month_spend(s, D.AS_OF)),
    "d05_abandoned_rate": _s(lambda s: I.abandoned_rate(s, D.AS_OF)),
    "d06_sessions_with_tool": _ts(lambda t, s: I.sessions_with_tool(s, t, "proj-3", "purchase")),
    "display_formats": _s(_display),
}

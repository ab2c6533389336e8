"""Measures the data model promises by name; the definitions are this library's."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import scalars as S
from tracewell.plans.reports import _asc, _desc, _limit, _tokens, _total_cost, weekly_spend


def cost_by_model(
    m: DataFrame, rates: Mapping[str, tuple[float, float]] = C.MODEL_RATES, cache_discount: float = C.CACHE_DISCOUNT
) -> DataFrame:
    """Cost per model at the rates of its family; NULL for a model of no known family.

    Messages are summed per model before any rate is looked up.
    """
    sums = (
        m.where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.count("*").alias("messages"),
            F.sum("input_tokens").alias("input_tok"),
            F.sum("output_tokens").alias("output_tok"),
            F.sum("cache_read_tokens").alias("cache_read"),
        )
        .withColumn("family", S.model_family(F.col("model"), tuple(rates)))
    )
    nano = F.lit(None).cast("bigint")
    for family, (rate_in, rate_out) in rates.items():
        cache_rate = S.nano_rate(round(rate_in * (1 - cache_discount), 9))
        cost = S.cost_nano(F.col("input_tok"), F.col("output_tok"), (rate_in, rate_out))
        nano = F.when(F.col("family") == family, cost + F.col("cache_read") * F.lit(cache_rate)).otherwise(nano)
    return sums.withColumn("est_cost_usd", S.usd(nano)).orderBy(_desc("est_cost_usd"), _asc("model"))


def top_prompts(s: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent first prompts, ignoring case and outer blanks."""
    out = (
        s.where(F.col("first_prompt").isNotNull())
        .groupBy(F.lower(F.trim("first_prompt")).alias("prompt"))
        .agg(F.count("*").alias("sessions"))
    )
    return _limit(out, limit, _desc("sessions"), _asc("prompt"))


def spend_trend(s: DataFrame) -> DataFrame:
    """Weekly spend with the change to the week before; the window sees one row per week."""
    cents = F.round(F.col("est_cost_usd") * 100).cast("bigint")
    weeks = weekly_spend(s, weeks=None).withColumn("cents", cents)
    before = F.lag("cents").over(Window.orderBy("week"))
    return weeks.withColumn("before", before).select(
        "week",
        "est_cost_usd",
        ((F.col("cents") - F.col("before")) / F.lit(100.0)).alias("change_usd"),
        S.delta_percent(F.col("cents"), F.col("before")).alias("change_pct"),
        F.when(F.col("cents") > F.col("before"), "up")
        .when(F.col("cents") < F.col("before"), "down")
        .when(F.col("cents") == F.col("before"), "flat")
        .alias("trend"),
    )


def month_spend(s: DataFrame, as_of: dt.date) -> DataFrame:
    first = as_of.replace(day=1)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    month = s.where((F.col("created_at") >= F.lit(first)) & (F.col("created_at") < F.lit(following)))
    return month.agg(F.count("*").alias("sessions"), _total_cost().alias("est_cost_usd"))


def abandoned_rate(s: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    recent = s.where(F.col("created_at") >= S.day_before(as_of, days))
    quick = F.count_if(F.col("message_count") <= C.ABANDONED_MESSAGES)
    return recent.agg(
        F.count("*").alias("sessions"),
        quick.alias("abandoned"),
        S.ratio_round(quick, F.count("*"), 1, percent=True).alias("abandoned_pct"),
    )


def sessions_with_tool(s: DataFrame, t: DataFrame, project: str, tool: str) -> DataFrame:
    """Sessions of a project that used a tool."""
    users = t.where(F.col("tool_name") == tool).select("session_id").distinct()
    return (
        s.where(F.col("project_name") == project)
        .join(users, "session_id", "left_semi")
        .select("session_id", "created_at", "message_count", _tokens().alias("tokens"))
        .orderBy(_desc("created_at"), _asc("session_id"))
    )

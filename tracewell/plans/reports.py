"""Reports over the tables. Every function takes and returns DataFrames.

Arguments: ``s`` sessions, ``t`` tool calls, ``m`` messages, ``h`` history or
hook events. ``as_of`` stands for today. NULLs sort last, and every top-k ends
its sort with a key so that ties have one answer.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import scalars as S



def _tokens() -> Column:
    return F.col("total_input_tokens") + F.col("total_output_tokens")


def _day() -> Column:
    return F.to_date("created_at")


def _limit(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def _desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def _asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _recent(df: DataFrame, column: str, as_of: dt.date, days: int) -> DataFrame:
    return df.where(F.col(column) >= S.day_before(as_of, days))


def _total_cost() -> Column:
    return S.usd(S.cost_nano(F.sum("total_input_tokens"), F.sum("total_output_tokens")))


def _session_cost() -> Column:
    return S.usd(S.cost_nano(F.col("total_input_tokens"), F.col("total_output_tokens")))


def _cache_share() -> Column:
    return S.ratio_round(
        F.sum("total_cache_read"),
        F.sum(F.col("total_input_tokens") + F.col("total_cache_read")),
        digits=1,
        percent=True,
    )


# --- token, tool and project summaries -------------------------------------------------


def tokens_by_project(s: DataFrame, as_of: dt.date, days: int = 7, limit: int = 30) -> DataFrame:
    out = (
        _recent(s, "created_at", as_of, days)
        .groupBy("project_name")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("total_input_tokens").alias("input_tok"),
            F.sum("total_output_tokens").alias("output_tok"),
            F.sum("total_cache_read").alias("cache_read"),
            F.sum("total_cache_write").alias("cache_write"),
            F.sum(_tokens()).alias("total"),
        )
    )
    return _limit(out, limit, _desc("total"), _asc("project_name"))


def tokens_grand_total(shown: DataFrame) -> DataFrame:
    """Totals of the rows shown, not of all projects."""
    return shown.agg(
        F.coalesce(F.sum("input_tok"), F.lit(0)).alias("total_in"),
        F.coalesce(F.sum("output_tok"), F.lit(0)).alias("total_out"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_all"),
    )


def tool_usage(t: DataFrame, as_of: dt.date, days: int = 7, limit: int = 30) -> DataFrame:
    out = (
        _recent(t, "timestamp", as_of, days)
        .groupBy("tool_name")
        .agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"))
    )
    return _limit(out, limit, _desc("calls"), _asc("tool_name"))


def tool_counts(
    t: DataFrame, as_of: dt.date | None = None, days: int = 7, limit: int = 20, name: str = "calls"
) -> DataFrame:
    """Calls per tool, of all time unless ``as_of`` is given."""
    src = t if as_of is None else _recent(t, "timestamp", as_of, days)
    out = src.groupBy("tool_name").agg(F.count("*").alias(name))
    return _limit(out, limit, _desc(name), _asc("tool_name"))


def favourite_tools(t: DataFrame, limit: int = 10) -> DataFrame:
    return tool_counts(t, limit=limit, name="uses")


def recent_sessions(s: DataFrame, limit: int = 20, prompt_len: int = 80) -> DataFrame:
    top = _limit(s, limit, _desc("created_at"), _asc("session_id"))
    return top.select(
        F.date_format("created_at", "MM-dd HH:mm").alias("started"),
        "project_name",
        F.col("message_count").alias("msgs"),
        _tokens().alias("tokens"),
        F.coalesce(F.left("first_prompt", F.lit(prompt_len)), F.lit("")).alias("prompt"),
        F.left("session_id", F.lit(8)).alias("id"),
    )


def recent_sessions_with_cost(s: DataFrame, limit: int = 30, prompt_len: int = 120) -> DataFrame:
    top = _limit(s, limit, _desc("created_at"), _asc("session_id"))
    return top.select(
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("started"),
        "project_name",
        F.col("message_count").alias("msgs"),
        _tokens().alias("tokens"),
        _session_cost().alias("est_cost_usd"),
        F.coalesce(F.left("first_prompt", F.lit(prompt_len)), F.lit("")).alias("prompt"),
        F.left("session_id", F.lit(8)).alias("id"),
    )


def project_summary(s: DataFrame, limit: int = 30) -> DataFrame:
    out = s.groupBy("project_name").agg(
        F.count("*").alias("sessions"),
        F.to_date(F.min("created_at")).alias("first_seen"),
        F.to_date(F.max("created_at")).alias("last_seen"),
        F.sum("message_count").alias("total_msgs"),
        F.sum(_tokens()).alias("total_tokens"),
    )
    return _limit(out, limit, _desc("last_seen"), _asc("project_name"))


def hook_summary(h: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    out = (
        _recent(h, "timestamp", as_of, days)
        .groupBy("event_type")
        .agg(
            F.count("*").alias("events"),
            F.countDistinct("session_id").alias("sessions"),
            F.to_date(F.min("timestamp")).alias("first"),
            F.to_date(F.max("timestamp")).alias("last"),
        )
    )
    return out.orderBy(_desc("events"), _asc("event_type"))


# --- search ------------------------------------------------------------------------------


def search_messages(
    m: DataFrame, s: DataFrame, query: str, limit: int = 20, excerpt: int = 200, literal: bool = False
) -> DataFrame:
    """Newest messages whose text contains the query.

    The top-k comes before the join: sessions are unique by key, so the join
    adds no rows, and only the hits meet it. With a limit the hits are at most that many rows and are
    found at once, so that the scan of the sessions is filtered by their keys.
    """
    hits = _limit(
        m.where(S.matches(F.col("text_content"), query, literal)).select(
            "session_id", "uuid", "type", "timestamp", F.left("text_content", F.lit(excerpt)).alias("content")
        ),
        limit,
        _desc("timestamp"),
        _asc("session_id"),
        _asc("uuid"),
    )
    names = s.select("session_id", "project_name")
    if limit is not None:
        found = hits.toArrow()
        hits = hits.sparkSession.createDataFrame(found, hits.schema)
        names = names.where(F.col("session_id").isin(sorted(set(found["session_id"].drop_null().to_pylist()))))
    return (
        hits.join(names, "session_id", "left")
        .orderBy(_desc("timestamp"), _asc("session_id"), _asc("uuid"))
        .select(
            "session_id", "project_name", "type", F.date_format("timestamp", "MM-dd HH:mm").alias("ts"), "content"
        )
    )


def search_history(h: DataFrame, query: str, limit: int = 10, literal: bool = False) -> DataFrame:
    hits = h.where(
        S.matches(F.col("content"), query, literal) | S.matches(F.col("description"), query, literal)
    ).select("category", "agent", "timestamp", "description", "file_path")
    return _limit(hits, limit, _desc("timestamp"), _asc("file_path")).select(
        "category", "agent", F.date_format("timestamp", "MM-dd").alias("date"), "description"
    )


def find_sessions(s: DataFrame, project_like: str, limit: int = 10, literal: bool = False) -> DataFrame:
    hits = s.where(S.matches(F.col("project_name"), project_like, literal)).select(
        "session_id", "created_at", "message_count", "first_prompt"
    )
    return _limit(hits, limit, _desc("created_at"), _asc("session_id"))


# --- tables and state ----------------------------------------------------------------------

COUNTED_TABLES = ("sessions", "messages", "tool_calls", "hook_events", "todos", "debug_logs", "research_history")


def table_stats(tables: Mapping[str, DataFrame], names: Sequence[str] = COUNTED_TABLES) -> DataFrame:
    """Rows per table, one scan each; a table that is missing counts 0."""
    out = None
    for name in names:
        if name in tables:
            one = tables[name].agg(F.count("*").alias("rows"))
        else:
            one = next(iter(tables.values())).where(F.lit(False)).agg(F.count("*").alias("rows"))
        one = one.select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sync_status(state: DataFrame) -> DataFrame:
    return state.select("source_name", "last_run", "files_synced", "rows_synced").orderBy("source_name")


def last_sync(state: DataFrame) -> DataFrame:
    return state.agg(F.max("last_run").alias("last_sync"))


def sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Spark SQL over the tables by their names. Only a query is taken: inside a subquery, commands are syntax errors.

    Names are bound by common table expressions over views of unique names that go again, so the caller's own views
    are neither replaced nor hidden for good.
    """
    views = {name: f"tracewell_{name}_{uuid.uuid4().hex}" for name in tables or {}}
    for name, view in views.items():
        tables[name].createTempView(view)
    try:
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql((f"WITH {named} " if named else "") + f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


# --- periods and trends ----------------------------------------------------------------------


def overview(s: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """This period against the one before: always two rows, from one scan.

    Rows are first folded per project, so the distinct count of projects needs
    no second pass over the sessions.
    """
    start, middle = S.day_before(as_of, 2 * days), S.day_before(as_of, days)
    current = F.col("created_at") >= middle
    per_project = (
        s.where(F.col("created_at") >= start)
        .groupBy("project_name")
        .agg(
            *(
                column
                for tag, cond in (("cur", current), ("prev", ~current))
                for column in (
                    F.count_if(cond).alias(f"{tag}_sessions"),
                    F.sum(F.when(cond, F.col("message_count"))).alias(f"{tag}_messages"),
                    F.count(F.when(cond, F.col("message_count"))).alias(f"{tag}_counted"),
                    F.sum(F.when(cond, _tokens())).alias(f"{tag}_tokens"),
                    F.sum(F.when(cond, F.col("total_input_tokens"))).alias(f"{tag}_in"),
                    F.sum(F.when(cond, F.col("total_output_tokens"))).alias(f"{tag}_out"),
                )
            )
        )
    )

    def period(label: str, tag: str) -> Column:
        return F.struct(
            F.lit(label).alias("period"),
            F.coalesce(F.sum(f"{tag}_sessions"), F.lit(0)).alias("sessions"),
            F.sum(f"{tag}_messages").alias("messages"),
            F.sum(f"{tag}_tokens").alias("total_tokens"),
            S.ratio_round(F.sum(f"{tag}_messages"), F.sum(f"{tag}_counted"), 1).alias("avg_msgs"),
            F.count_if((F.col(f"{tag}_sessions") > 0) & F.col("project_name").isNotNull()).alias("projects"),
            S.usd(S.cost_nano(F.sum(f"{tag}_in"), F.sum(f"{tag}_out"))).alias("est_cost_usd"),
        )

    both = per_project.agg(F.array(period("last_30d", "cur"), period("prev_30d", "prev")).alias("p"))
    return both.select(F.inline("p"))


def overview_delta(o: DataFrame) -> DataFrame:
    """Change of each card in percent; NULL where the earlier period has nothing."""
    cards = ("sessions", "messages", "total_tokens", "projects")
    is_cur, is_prev = F.col("period") == "last_30d", F.col("period") == "prev_30d"
    values = [(c, F.col(c)) for c in cards]
    values.append(("est_cost_usd", F.round(F.col("est_cost_usd") * 100).cast("bigint")))
    one = o.agg(
        *(
            column
            for name, value in values
            for column in (
                F.max(F.when(is_cur, value)).alias(f"{name}_cur"),
                F.max(F.when(is_prev, value)).alias(f"{name}_prev"),
            )
        )
    )
    return one.select(
        *(S.delta_percent(F.col(f"{n}_cur"), F.col(f"{n}_prev")).alias(f"{n}_delta_pct") for n, _ in values)
    )


def daily_activity(s: DataFrame, as_of: dt.date, days: int = 14, newest_first: bool = False) -> DataFrame:
    out = (
        _recent(s, "created_at", as_of, days)
        .groupBy(_day().alias("day"))
        .agg(F.count("*").alias("sessions"), F.sum("message_count").alias("msgs"))
    )
    return out.orderBy(_desc("day") if newest_first else _asc("day"))


def write_read_ratio(
    t: DataFrame,
    weeks: int = 8,
    writes: Sequence[str] = C.WRITE_TOOLS,
    reads: Sequence[str] = C.READ_TOOLS,
    newest_first: bool = False,
) -> DataFrame:
    is_write, is_read = F.col("tool_name").isin(*writes), F.col("tool_name").isin(*reads)
    weekly = t.groupBy(F.to_date(F.date_trunc("week", "timestamp")).alias("week")).agg(
        F.count_if(is_write).alias("writes"),
        F.count_if(is_read).alias("reads"),
        S.ratio_round(F.count_if(is_write), F.count_if(is_read), 2).alias("write_read_ratio"),
    )
    latest = _limit(weekly, weeks, _desc("week"))
    return latest if newest_first else latest.orderBy(_asc("week"))


def weekly_spend(s: DataFrame, weeks: int | None = 12) -> DataFrame:
    out = s.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(
        F.count("*").alias("sessions"),
        F.sum("total_input_tokens").alias("input_tok"),
        F.sum("total_output_tokens").alias("output_tok"),
        F.sum("total_cache_read").alias("cache_tok"),
        _total_cost().alias("est_cost_usd"),
    )
    return _limit(out, weeks, _desc("week"))


def daily_spend(s: DataFrame, days: int = 14) -> DataFrame:
    out = s.groupBy(_day().alias("day")).agg(
        F.count("*").alias("sessions"),
        F.sum("total_input_tokens").alias("input_tok"),
        F.sum("total_output_tokens").alias("output_tok"),
        _total_cost().alias("cost_usd"),
    )
    return _limit(out, days, _desc("day"))


def worklog(s: DataFrame, as_of: dt.date, days: int = 7, tokens: bool = False) -> DataFrame:
    measure = F.sum(_tokens()).alias("total") if tokens else F.sum("message_count").alias("msgs")
    out = _recent(s, "created_at", as_of, days).groupBy("project_name").agg(F.count("*").alias("sessions"), measure)
    return out.orderBy(_desc("total" if tokens else "sessions"), _asc("project_name"))


# --- cost ----------------------------------------------------------------------------------


def cost_by_project(s: DataFrame, as_of: dt.date, days: int = 30, limit: int | None = 10) -> DataFrame:
    out = (
        _recent(s, "created_at", as_of, days)
        .groupBy("project_name")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("total_input_tokens").alias("input_tok"),
            F.sum("total_output_tokens").alias("output_tok"),
            F.sum("total_cache_read").alias("cache_read"),
            _cache_share().alias("cache_hit_pct"),
            _total_cost().alias("est_cost_usd"),
        )
    )
    return _limit(out, limit, _desc("est_cost_usd"), _asc("project_name"))


def cost_and_cache_by_project(s: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    out = (
        _recent(s, "created_at", as_of, days)
        .groupBy("project_name")
        .agg(
            F.count("*").alias("sessions"),
            F.sum(_tokens()).alias("total_tok"),
            _total_cost().alias("est_cost_usd"),
            _cache_share().alias("cache_pct"),
        )
    )
    return out.orderBy(_desc("est_cost_usd"), _asc("project_name"))


def costliest_sessions(s: DataFrame, limit: int = 10, prompt_len: int = 80) -> DataFrame:
    cost = _session_cost()
    top = _limit(s.withColumn("est_cost_usd", cost), limit, _desc("est_cost_usd"), _asc("session_id"))
    return top.select(
        "project_name",
        _day().alias("created_on"),
        "message_count",
        _tokens().alias("total_tok"),
        "est_cost_usd",
        F.left("first_prompt", F.lit(prompt_len)).alias("prompt"),
    )


def _abandoned(s: DataFrame) -> DataFrame:
    return s.where((F.col("message_count") <= C.ABANDONED_MESSAGES) & (_tokens() > C.ABANDONED_TOKENS))


def abandoned_costly(s: DataFrame, limit: int = 10, prompt_len: int = 80) -> DataFrame:
    out = _abandoned(s).withColumn("wasted_usd", _session_cost())
    return _limit(out, limit, _desc("wasted_usd"), _asc("session_id")).select(
        "project_name",
        _day().alias("created_on"),
        "message_count",
        "wasted_usd",
        F.left("first_prompt", F.lit(prompt_len)).alias("prompt"),
    )


def abandoned_by_tokens(s: DataFrame, limit: int = 10) -> DataFrame:
    out = _abandoned(s).withColumn("wasted_tokens", _tokens())
    return _limit(out, limit, _desc("wasted_tokens"), _asc("session_id")).select(
        "project_name", "first_prompt", "message_count", "wasted_tokens"
    )


def cache_savings(s: DataFrame, as_of: dt.date, days: int = 30, limit: int = 10) -> DataFrame:
    saved_per_token = S.nano_rate(round(C.FLAT_RATE[0] * C.CACHE_DISCOUNT, 9))
    out = (
        _recent(s, "created_at", as_of, days)
        .groupBy("project_name")
        .agg(
            F.sum("total_cache_read").alias("cache_read"),
            F.sum("total_input_tokens").alias("input_tok"),
            S.usd(F.sum("total_cache_read") * F.lit(saved_per_token)).alias("est_saved_usd"),
            _cache_share().alias("cache_pct"),
        )
        .where(F.col("cache_read") > 0)
    )
    return _limit(out, limit, _desc("est_saved_usd"), _asc("project_name"))


# --- session shape ------------------------------------------------------------------------------


def tool_share(t: DataFrame, as_of: dt.date, days: int = 30, limit: int | None = 10) -> DataFrame:
    """Calls and share of all calls; the share is taken before the limit.

    The total is a scalar over the grouped counts, which share one shuffle.
    """
    counts = _recent(t, "timestamp", as_of, days).groupBy("tool_name").agg(F.count("*").alias("calls"))
    total = counts.agg(F.sum("calls")).scalar()
    out = counts.withColumn("pct", S.ratio_round(F.col("calls"), total, 1, percent=True))
    return _limit(out, limit, _desc("calls"), _asc("tool_name"))


def session_buckets(
    s: DataFrame, as_of: dt.date, days: int = 30, labels: Sequence[str] = S.MESSAGE_LABELS
) -> DataFrame:
    return (
        _recent(s, "created_at", as_of, days)
        .groupBy(S.message_bucket(F.col("message_count"), labels).alias("bucket"))
        .agg(
            F.count("*").alias("sessions"),
            S.ratio_round(F.sum(_tokens()), F.count(_tokens())).alias("avg_tokens"),
            S.ratio_round(F.sum("message_count"), F.count("message_count"), 1).alias("avg_msgs"),
            F.min("message_count").alias("smallest"),
        )
        .orderBy(_asc("smallest"), _asc("bucket"))
        .drop("smallest")
    )


def prompt_quality(
    s: DataFrame, as_of: dt.date, days: int = 30, labels: Sequence[str] = S.PROMPT_LABELS, cost: bool = True
) -> DataFrame:
    nano = S.cost_nano(F.sum("total_input_tokens"), F.sum("total_output_tokens"))
    n = F.count(_tokens())
    avg_cost = S.ratio_round(nano, n * F.lit(S.NANO_PER_CENT), 0) / F.lit(100.0)
    out = (
        _recent(s, "created_at", as_of, days)
        .where(F.col("first_prompt").isNotNull())
        .groupBy(S.prompt_bucket(F.col("first_prompt"), labels).alias("prompt_length"))
        .agg(
            F.count("*").alias("sessions"),
            S.ratio_round(F.sum("message_count"), F.count("message_count"), 1).alias("avg_msgs"),
            S.ratio_round(F.sum(_tokens()), n).alias("avg_tokens"),
            *([avg_cost.alias("avg_cost_usd")] if cost else []),
            F.min(F.length("first_prompt")).alias("shortest"),
        )
    )
    return out.orderBy(_asc("shortest"), _asc("prompt_length")).drop("shortest")


def prompt_len_vs_tokens(s: DataFrame, limit: int = 20, more_than: int = 3) -> DataFrame:
    out = s.where(F.col("message_count") > more_than).select(
        F.length("first_prompt").alias("prompt_len"), "message_count", _tokens().alias("total_tokens"), "session_id"
    )
    return _limit(out, limit, _desc("total_tokens"), _asc("session_id")).drop("session_id")


# --- all-time highlights -----------------------------------------------------------------------


def longest_streak(s: DataFrame, by: str | None = None) -> DataFrame:
    """Longest run of consecutive active days, over all sessions or per ``by``.

    The window sees distinct days only, at most one row per calendar day and group.
    """
    keys = [by] if by else []
    days = s.where(_day().isNotNull()).select(*keys, _day().alias("d")).distinct()
    order = Window.partitionBy(*keys).orderBy("d")
    runs = (
        days.withColumn("grp", F.date_sub("d", F.row_number().over(order)))
        .groupBy(*keys, "grp")
        .agg(F.count("*").alias("streak_days"), F.min("d").alias("from_date"), F.max("d").alias("to_date"))
    )
    if not by:
        return _limit(runs, 1, _desc("streak_days"), _asc("from_date")).select("streak_days", "from_date", "to_date")
    best = F.min(F.struct(-F.col("streak_days"), F.col("from_date"), F.col("to_date"))).alias("b")
    return runs.groupBy(by).agg(best).select(
        by, (-F.col("b.col1")).alias("streak_days"), F.col("b.from_date"), F.col("b.to_date")
    )


def peak_hours(s: DataFrame, k: int = 3) -> DataFrame:
    out = s.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("sessions"))
    return _limit(out, k, _desc("sessions"), _asc("hour"))


def marathon(s: DataFrame, prompt_len: int = 100, cost: bool = True) -> DataFrame:
    top = _limit(s, 1, _desc("message_count"), _asc("session_id"))
    return top.select(
        "project_name",
        _day().alias("date"),
        F.col("message_count").alias("msgs"),
        _tokens().alias("tokens"),
        *([_session_cost().alias("est_cost_usd")] if cost else []),
        F.left("first_prompt", F.lit(prompt_len)).alias("prompt"),
    )


def biggest_session(s: DataFrame, prompt_len: int = 100) -> DataFrame:
    """The session with most tokens, shown with its cost; cost may rank another one first."""
    top = _limit(s.withColumn("tokens", _tokens()), 1, _desc("tokens"), _asc("session_id"))
    return top.select(
        "project_name",
        _day().alias("date"),
        "message_count",
        _session_cost().alias("est_cost_usd"),
        F.left("first_prompt", F.lit(prompt_len)).alias("prompt"),
    )


def all_time(s: DataFrame, cost: bool = True) -> DataFrame:
    return s.agg(
        F.count("*").alias("total_sessions"),
        F.sum("message_count").alias("total_messages"),
        F.sum(_tokens()).alias("total_tokens"),
        F.countDistinct("project_name").alias("total_projects"),
        F.to_date(F.min("created_at")).alias("first_session"),
        F.to_date(F.max("created_at")).alias("latest_session"),
        *([_total_cost().alias("total_cost_usd")] if cost else []),
    )


def developer_type(
    t: DataFrame,
    labels: Mapping[str, str] = C.DEVELOPER_TYPES,
    default: str = C.DEFAULT_DEVELOPER_TYPE,
) -> DataFrame:
    """The most used tool and the label it stands for; one row even without calls."""
    counts = t.groupBy("tool_name").agg(F.count("*").alias("calls"))
    top = counts.agg(
        F.min_by("tool_name", F.struct(-F.col("calls"), F.col("tool_name"))).alias("tool"),
        F.count("*").alias("tools"),
    )
    tool = F.when(F.col("tools") == 0, "unknown").otherwise(F.col("tool"))
    label = F.lit(default)
    for name, text in labels.items():
        label = F.when(tool == name, text).otherwise(label)
    return top.select(label.alias("dev_type"), tool.alias("top_tool"))


def top_projects(s: DataFrame, limit: int = 5) -> DataFrame:
    out = s.groupBy("project_name").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))
    return _limit(out, limit, _desc("sessions"), _asc("project_name"))


def busiest_day(s: DataFrame) -> DataFrame:
    out = s.groupBy(_day().alias("day")).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))
    return _limit(out, 1, _desc("sessions"), _asc("day"))


def model_usage(m: DataFrame, limit: int = 5) -> DataFrame:
    out = m.where(F.col("model").isNotNull()).groupBy("model").agg(F.count("*").alias("messages"))
    return _limit(out, limit, _desc("messages"), _asc("model"))


# --- joins by session date --------------------------------------------------------------------


def _counts_in_range(
    df: DataFrame, s: DataFrame, key: str, name: str, lo: dt.date, hi: dt.date | None, limit: int | None
) -> DataFrame:
    """Rows per ``key``, dated by their session.

    Rows of sessions out of range go first: where the range leaves few
    sessions, these are broadcast and the history is only filtered.
    """
    in_range = F.col("created_at") >= F.lit(lo)
    if hi is not None:
        in_range = in_range & (F.col("created_at") < F.lit(hi))
    wanted = s.where(in_range).select("session_id")
    out = df.join(wanted, "session_id", "left_semi").groupBy(key).agg(F.count("*").alias(name))
    return _limit(out, limit, _desc(name), _asc(key))


def tools_in_range(
    t: DataFrame, s: DataFrame, lo: dt.date, hi: dt.date | None = None, limit: int | None = None
) -> DataFrame:
    return _counts_in_range(t, s, "tool_name", "uses", lo, hi, limit)


def models_in_range(
    m: DataFrame, s: DataFrame, lo: dt.date, hi: dt.date | None = None, limit: int | None = None
) -> DataFrame:
    return _counts_in_range(m.where(F.col("model").isNotNull()), s, "model", "messages", lo, hi, limit)

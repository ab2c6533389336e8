"""The report queries as plain SQL, written against the given tables."""

from __future__ import annotations

MSG = """
w_msg AS (
  SELECT concat('u', CAST(user_id AS VARCHAR), '-',
           CASE user_id % 3 WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR)
                            WHEN 1 THEN CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR)
                            ELSE 'all' END) AS session_id,
         concat('e', CAST(event_id AS VARCHAR)) AS uuid,
         concat('proj-', CAST(user_id % 12 AS VARCHAR)) AS project_name,
         ts AS timestamp, event_type AS tool_name, event_id,
         CASE event_id % 3 WHEN 0 THEN 'model-sonnet-1' WHEN 1 THEN 'model-opus-1' ELSE 'model-haiku-1' END AS model,
         CAST(floor(value * 100) AS BIGINT) AS input_tokens,
         CAST(floor(value * 10) AS BIGINT) AS output_tokens,
         CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 100) AS BIGINT) * 3 ELSE 0 END AS cache_read_tokens,
         CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS cache_write_tokens
  FROM events
)"""

SES = (
    MSG
    + """,
w_ses0 AS (
  SELECT session_id, project_name, min(timestamp) AS created_at, max(timestamp) AS modified_at,
         count(*) AS message_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
         CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
         CAST(sum(cache_read_tokens) AS BIGINT) AS total_cache_read,
         CAST(sum(cache_write_tokens) AS BIGINT) AS total_cache_write,
         min(event_id) AS first_event
  FROM w_msg GROUP BY session_id, project_name
),
w_ses AS (
  SELECT a.*, total_input_tokens + total_output_tokens AS tokens,
         3000 * total_input_tokens + 15000 * total_output_tokens AS nano,
         CASE WHEN first_event % 11 <> 0 THEN d.text END AS first_prompt
  FROM w_ses0 a LEFT JOIN documents d ON d.doc_id = a.first_event % (SELECT count(*) FROM documents)
)"""
)

CONV = """
c_msg AS (
  SELECT concat('c', CAST(conv_id AS VARCHAR)) AS session_id,
         concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS uuid,
         role AS type, conv_id, text AS text_content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 37 + turn) AS timestamp
  FROM conversations
),
c_ses AS (
  SELECT session_id, conv_id, concat('proj_', CAST(conv_id % 12 AS VARCHAR)) AS project_name,
         min(timestamp) AS created_at, count(*) AS message_count,
         arg_min(text_content, timestamp) AS first_prompt
  FROM c_msg GROUP BY session_id, conv_id
)"""


def ratio(num: str, den: str, digits: int = 0, percent: bool = False) -> str:
    scale = 10 ** (digits + (2 if percent else 0))
    n, d = f"CAST({num} AS HUGEINT)", f"CAST(NULLIF({den}, 0) AS HUGEINT)"
    size = f"((2 * abs({n}) * {scale} + abs({d})) // (2 * abs({d})))"
    return f"CAST(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{size} ELSE {size} END AS DOUBLE) / {float(10**digits)}"


def usd(nano: str) -> str:
    return f"(({nano} + 5000000) // 10000000) / 100.0"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


SUM_NANO = "CAST(sum(nano) AS HUGEINT)"
CACHE_PCT = ratio("sum(total_cache_read)", "sum(total_input_tokens + total_cache_read)", 1, True)
TOTAL_COST = usd(SUM_NANO)


def since(column: str, days: int) -> str:
    return f"{column} >= DATE '2024-01-31' - INTERVAL {days} DAY"


def s(body: str) -> str:
    return f"WITH {SES}\n{body}"


def m(body: str) -> str:
    return f"WITH {MSG}\n{body}"


def c(body: str) -> str:
    return f"WITH {CONV}\n{body}"


TOKENS_BY_PROJECT = f"""
  SELECT project_name, count(*) AS sessions, {big('sum(total_input_tokens)')} AS input_tok,
         {big('sum(total_output_tokens)')} AS output_tok, {big('sum(total_cache_read)')} AS cache_read,
         {big('sum(total_cache_write)')} AS cache_write, {big('sum(tokens)')} AS total
  FROM w_ses WHERE {since('created_at', 7)}
  GROUP BY project_name ORDER BY total DESC NULLS LAST, project_name"""


def recent(fmt: str, width: int, limit: int, cost: bool) -> str:
    extra = f"{usd('nano')} AS est_cost_usd, " if cost else ""
    return s(
        f"""SELECT strftime(created_at, '{fmt}') AS started, project_name, message_count AS msgs, tokens, {extra}
        coalesce(substr(first_prompt, 1, {width}), '') AS prompt, substr(session_id, 1, 8) AS id
        FROM w_ses ORDER BY created_at DESC NULLS LAST, session_id LIMIT {limit}"""
    )


def search(predicate: str) -> str:
    return c(
        f"""SELECT h.session_id, s.project_name, h.type, strftime(h.timestamp, '%m-%d %H:%M') AS ts,
        substr(h.text_content, 1, 200) AS content
        FROM (SELECT * FROM c_msg WHERE {predicate} ORDER BY timestamp DESC, session_id, uuid LIMIT 20) h
        LEFT JOIN c_ses s ON h.session_id = s.session_id"""
    )


def overview(days: int) -> str:
    def half(label: str, where: str) -> str:
        return f"""SELECT '{label}' AS period, count(*) AS sessions, {big('sum(message_count)')} AS messages,
          {big('sum(tokens)')} AS total_tokens, {ratio('sum(message_count)', 'count(message_count)', 1)} AS avg_msgs,
          count(DISTINCT project_name) AS projects, {TOTAL_COST} AS est_cost_usd FROM w_ses WHERE {where}"""

    return (
        half("last_30d", since("created_at", days))
        + " UNION ALL "
        + half(
            "prev_30d",
            f"{since('created_at', 2 * days)} AND created_at < DATE '2024-01-31' - INTERVAL {days} DAY",
        )
    )


def delta(name: str, value: str) -> str:
    cur = f"(SELECT {value} FROM o WHERE period = 'last_30d')"
    prev = f"(SELECT {value} FROM o WHERE period = 'prev_30d')"
    return f"{big(ratio(f'({cur} - {prev})', prev, 0, True))} AS {name}_delta_pct"


def buckets(labels: tuple[str, ...]) -> str:
    return s(
        f"""SELECT CASE WHEN message_count <= 3 THEN '{labels[0]}' WHEN message_count <= 10 THEN '{labels[1]}'
          WHEN message_count <= 30 THEN '{labels[2]}' ELSE '{labels[3]}' END AS bucket, count(*) AS sessions,
          {ratio('sum(tokens)', 'count(tokens)')} AS avg_tokens,
          {ratio('sum(message_count)', 'count(message_count)', 1)} AS avg_msgs
        FROM w_ses WHERE {since('created_at', 30)} GROUP BY 1"""
    )


def prompts(labels: tuple[str, ...], cost: bool) -> str:
    extra = f", {ratio(SUM_NANO, 'count(*) * 10000000')} / 100.0 AS avg_cost_usd" if cost else ""
    return s(
        f"""SELECT CASE WHEN length(first_prompt) < 50 THEN '{labels[0]}' WHEN length(first_prompt) < 200 THEN '{labels[1]}'
          ELSE '{labels[2]}' END AS prompt_length, count(*) AS sessions,
          {ratio('sum(message_count)', 'count(message_count)', 1)} AS avg_msgs,
          {ratio('sum(tokens)', 'count(tokens)')} AS avg_tokens{extra}
        FROM w_ses WHERE {since('created_at', 30)} AND first_prompt IS NOT NULL GROUP BY 1"""
    )


def weekly_ratio(writes: str, weeks: int) -> str:
    w, r = f"count(*) FILTER (WHERE tool_name IN ({writes}))", "count(*) FILTER (WHERE tool_name = 'view')"
    return m(
        f"""SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, {w} AS writes, {r} AS reads,
          {ratio(w, r, 2)} AS write_read_ratio
        FROM w_msg GROUP BY 1 ORDER BY 1 DESC LIMIT {weeks}"""
    )


def in_range(key: str, name: str) -> str:
    return s(
        f"""SELECT m.{key}, count(*) AS {name} FROM w_msg m JOIN w_ses s ON m.session_id = s.session_id
        WHERE s.created_at >= DATE '2024-01-08' AND s.created_at < DATE '2024-01-22' GROUP BY 1"""
    )


def streak(keys: str, tail: str) -> str:
    part = f"PARTITION BY {keys[:-2]}" if keys else ""
    return s(
        f"""SELECT * FROM (SELECT {keys}count(*) AS streak_days, min(d) AS from_date, max(d) AS to_date
          FROM (SELECT *, d - CAST(row_number() OVER ({part} ORDER BY d) AS INTEGER) AS grp
                FROM (SELECT DISTINCT {keys}CAST(created_at AS DATE) AS d FROM w_ses))
          GROUP BY {keys}grp) {tail}"""
    )


def human(n: str, up: bool) -> str:
    """Thousands and millions with exact ties: to even, or up."""

    def nearest(value: str, unit: int) -> str:
        q, rest = f"({value} // {unit})", f"({value} % {unit})"
        tie = f"{q} + 1" if up else f"{q} + {q} % 2"
        return f"(CASE WHEN 2 * {rest} > {unit} THEN {q} + 1 WHEN 2 * {rest} = {unit} THEN {tie} ELSE {q} END)"

    tenths = nearest(n, 100000)
    return (
        f"CASE WHEN {n} >= 1000000 THEN concat(CAST({tenths} // 10 AS VARCHAR), '.', CAST({tenths} % 10 AS VARCHAR), 'M') "
        f"WHEN {n} >= 1000 THEN concat(CAST({nearest(n, 1000)} AS VARCHAR), 'K') ELSE CAST({n} AS VARCHAR) END"
    )


STATE = """SELECT project_name AS source_name, max(timestamp) AS last_run,
  count(DISTINCT session_id) AS files_synced, count(*) AS rows_synced FROM w_msg GROUP BY 1"""

ORACLE = {
    "r01_tokens_by_project": s(f"{TOKENS_BY_PROJECT} LIMIT 30"),
    "r01_tokens_grand_total": s(
        f"""SELECT {big('sum(input_tok)')} AS total_in, {big('sum(output_tok)')} AS total_out,
        {big('sum(total)')} AS total_all FROM ({TOKENS_BY_PROJECT} LIMIT 5)"""
    ),
    "r02_tool_usage": m(
        f"""SELECT tool_name, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM w_msg
        WHERE {since('timestamp', 7)} GROUP BY 1 ORDER BY calls DESC, tool_name LIMIT 30"""
    ),
    "r02_tool_counts_week": m(
        f"SELECT tool_name, count(*) AS calls FROM w_msg WHERE {since('timestamp', 7)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    ),
    "r03_recent_sessions": recent("%m-%d %H:%M", 80, 20, False),
    "r03_recent_sessions_with_cost": recent("%Y-%m-%d %H:%M", 120, 30, True),
    "r04_search_messages": search("text_content ILIKE '%ment%'"),
    "r04_search_messages_wildcard": search("text_content ILIKE '%l_ m%t%'"),
    "r04_search_messages_literal": search("contains(lower(text_content), lower('ÉON'))"),
    "r05_search_history": """SELECT source AS category, lang AS agent,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%m-%d') AS date,
        concat('note on ', source, ' in ', lang) AS description
      FROM documents
      WHERE text ILIKE '%ment%' OR concat('note on ', source, ' in ', lang) ILIKE '%ment%'
      ORDER BY doc_id DESC LIMIT 10""",
    "r06_project_summary": s(
        f"""SELECT project_name, count(*) AS sessions, CAST(min(created_at) AS DATE) AS first_seen,
        CAST(max(created_at) AS DATE) AS last_seen, {big('sum(message_count)')} AS total_msgs,
        {big('sum(tokens)')} AS total_tokens
        FROM w_ses GROUP BY 1 ORDER BY last_seen DESC, project_name LIMIT 30"""
    ),
    "r07_table_stats": s(
        """SELECT 'sessions' AS table_name, count(*) AS rows FROM w_ses
        UNION ALL SELECT 'messages', count(*) FROM events UNION ALL SELECT 'tool_calls', count(*) FROM events
        UNION ALL SELECT 'hook_events', count(*) FROM events UNION ALL SELECT 'todos', 0
        UNION ALL SELECT 'debug_logs', 0 UNION ALL SELECT 'research_history', count(*) FROM documents"""
    ),
    "r07_sync_status": m(STATE),
    "r08_hook_summary": m(
        f"""SELECT tool_name AS event_type, count(*) AS events, count(DISTINCT session_id) AS sessions,
        CAST(min(timestamp) AS DATE) AS first, CAST(max(timestamp) AS DATE) AS last
        FROM w_msg WHERE {since('timestamp', 7)} GROUP BY 1"""
    ),
    "r09_raw_sql": s(
        """SELECT t.tool_name, s.project_name, count(*) AS calls, count(DISTINCT t.session_id) AS sessions
        FROM w_msg t JOIN w_ses s ON t.session_id = s.session_id WHERE s.message_count > 3 GROUP BY 1, 2"""
    ),
    "r10_overview": s(overview(30)),
    "r10_overview_half_month": s(overview(15)),
    "r11_overview_delta": (
        f"WITH {SES}, o AS ({overview(15)}) SELECT "
        + ", ".join(
            [delta(n, n) for n in ("sessions", "messages", "total_tokens", "projects")]
            + [delta("est_cost_usd", "CAST(round(est_cost_usd * 100) AS BIGINT)")]
        )
    ),
    "r12_last_sync": m(f"SELECT max(last_run) AS last_sync FROM ({STATE})"),
    "r13_cost_by_project": s(
        f"""SELECT project_name, count(*) AS sessions, {big('sum(total_input_tokens)')} AS input_tok,
        {big('sum(total_output_tokens)')} AS output_tok, {big('sum(total_cache_read)')} AS cache_read,
        {CACHE_PCT} AS cache_hit_pct, {TOTAL_COST} AS est_cost_usd
        FROM w_ses WHERE {since('created_at', 30)} GROUP BY 1 ORDER BY est_cost_usd DESC, project_name LIMIT 10"""
    ),
    "r13_cost_and_cache_by_project": s(
        f"""SELECT project_name, count(*) AS sessions, {big('sum(tokens)')} AS total_tok,
        {TOTAL_COST} AS est_cost_usd, {CACHE_PCT} AS cache_pct
        FROM w_ses WHERE {since('created_at', 30)} GROUP BY 1"""
    ),
    "r14_tool_share": m(
        f"""SELECT tool_name, calls, {ratio('calls', 'total', 1, True)} AS pct
        FROM (SELECT tool_name, count(*) AS calls, sum(count(*)) OVER () AS total FROM w_msg
              WHERE {since('timestamp', 30)} GROUP BY 1) ORDER BY calls DESC, tool_name LIMIT 3"""
    ),
    "r15_daily_activity": s(
        f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS sessions, {big('sum(message_count)')} AS msgs
        FROM w_ses WHERE {since('created_at', 14)} GROUP BY 1"""
    ),
    "r16_write_read_ratio": weekly_ratio("'signup', 'purchase'", 8),
    "r16_edit_read_ratio": weekly_ratio("'signup'", 12),
    "r17_session_buckets": buckets(("abandoned", "short", "medium", "long")),
    "r17_session_buckets_long_labels": buckets(
        ("abandoned (1-3 msgs)", "short (4-10 msgs)", "medium (11-30 msgs)", "long (30+ msgs)")
    ),
    "r18_prompt_quality": prompts(("short", "medium", "detailed"), True),
    "r18_prompt_quality_long_labels": prompts(("short (<50 chars)", "medium (50-200)", "detailed (200+)"), False),
    "r19_longest_streak": streak("", "ORDER BY streak_days DESC, from_date LIMIT 1"),
    "r19_longest_streak_by_project": streak(
        "project_name, ",
        "QUALIFY row_number() OVER (PARTITION BY project_name ORDER BY streak_days DESC, from_date) = 1",
    ),
    "r20_peak_hours": s(
        "SELECT CAST(extract(hour FROM created_at) AS INTEGER) AS hour, count(*) AS sessions FROM w_ses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
    ),
    "r21_marathon": s(
        f"""SELECT project_name, CAST(created_at AS DATE) AS date, message_count AS msgs, tokens,
        {usd('nano')} AS est_cost_usd, substr(first_prompt, 1, 100) AS prompt
        FROM w_ses ORDER BY message_count DESC, session_id LIMIT 1"""
    ),
    "r22_all_time": s(
        f"""SELECT count(*) AS total_sessions, {big('sum(message_count)')} AS total_messages,
        {big('sum(tokens)')} AS total_tokens, count(DISTINCT project_name) AS total_projects,
        CAST(min(created_at) AS DATE) AS first_session, CAST(max(created_at) AS DATE) AS latest_session,
        {TOTAL_COST} AS total_cost_usd FROM w_ses"""
    ),
    "r23_developer_type": """SELECT CASE top_tool WHEN 'view' THEN 'The Scholar' WHEN 'purchase' THEN 'The Surgeon'
        WHEN 'click' THEN 'The Hacker' ELSE 'The Polyglot' END AS dev_type, top_tool
      FROM (SELECT event_type AS top_tool, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)""",
    "r24_weekly_spend": s(
        f"""SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS sessions,
        {big('sum(total_input_tokens)')} AS input_tok, {big('sum(total_output_tokens)')} AS output_tok,
        {big('sum(total_cache_read)')} AS cache_tok, {TOTAL_COST} AS est_cost_usd
        FROM w_ses GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""
    ),
    "r25_costliest_sessions": s(
        f"""SELECT project_name, CAST(created_at AS DATE) AS created_on, message_count, tokens AS total_tok,
        {usd('nano')} AS est_cost_usd, substr(first_prompt, 1, 80) AS prompt
        FROM w_ses ORDER BY est_cost_usd DESC, session_id LIMIT 10"""
    ),
    "r26_abandoned_costly": s(
        f"""SELECT project_name, CAST(created_at AS DATE) AS created_on, message_count, {usd('nano')} AS wasted_usd,
        substr(first_prompt, 1, 80) AS prompt FROM w_ses WHERE message_count <= 3 AND tokens > 10000
        ORDER BY wasted_usd DESC, session_id LIMIT 10"""
    ),
    "r26_abandoned_by_tokens": s(
        """SELECT project_name, first_prompt, message_count, tokens AS wasted_tokens FROM w_ses
        WHERE message_count <= 3 AND tokens > 10000 ORDER BY wasted_tokens DESC, session_id LIMIT 10"""
    ),
    "r27_cache_savings": s(
        f"""SELECT project_name, {big('sum(total_cache_read)')} AS cache_read, {big('sum(total_input_tokens)')} AS input_tok,
        {usd('sum(total_cache_read) * 2700')} AS est_saved_usd, {CACHE_PCT} AS cache_pct
        FROM w_ses WHERE {since('created_at', 30)} GROUP BY 1 HAVING sum(total_cache_read) > 0
        ORDER BY est_saved_usd DESC, project_name LIMIT 10"""
    ),
    "r28_top_projects": s(
        f"""SELECT project_name, count(*) AS sessions, {big('sum(message_count)')} AS messages FROM w_ses
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
    ),
    "r29_favourite_tools": "SELECT event_type AS tool_name, count(*) AS uses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "r30_biggest_session": s(
        f"""SELECT project_name, CAST(created_at AS DATE) AS date, message_count, {usd('nano')} AS est_cost_usd,
        substr(first_prompt, 1, 100) AS prompt FROM w_ses ORDER BY tokens DESC, session_id LIMIT 1"""
    ),
    "r31_busiest_day": s(
        f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS sessions, {big('sum(message_count)')} AS messages
        FROM w_ses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""
    ),
    "r32_model_usage": m("SELECT model, count(*) AS messages FROM w_msg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "r33_worklog": s(
        f"""SELECT project_name, count(*) AS sessions, {big('sum(message_count)')} AS msgs FROM w_ses
        WHERE {since('created_at', 7)} GROUP BY 1"""
    ),
    "r33_worklog_tokens": s(
        f"""SELECT project_name, count(*) AS sessions, {big('sum(tokens)')} AS total FROM w_ses
        WHERE {since('created_at', 7)} GROUP BY 1"""
    ),
    "r34_prompt_len_vs_tokens": s(
        """SELECT CAST(length(first_prompt) AS INTEGER) AS prompt_len, message_count, tokens AS total_tokens
        FROM w_ses WHERE message_count > 3 ORDER BY tokens DESC, session_id LIMIT 20"""
    ),
    "r35_daily_spend": s(
        f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS sessions, {big('sum(total_input_tokens)')} AS input_tok,
        {big('sum(total_output_tokens)')} AS output_tok, {TOTAL_COST} AS cost_usd
        FROM w_ses GROUP BY 1 ORDER BY 1 DESC LIMIT 14"""
    ),
    "r36_find_sessions": c(
        """SELECT session_id, created_at, message_count, first_prompt FROM c_ses WHERE project_name ILIKE '%OJ_1%'
        ORDER BY created_at DESC, session_id LIMIT 10"""
    ),
    "r37_tools_in_range": in_range("tool_name", "uses"),
    "r38_models_in_range": in_range("model", "messages"),
    "d01_cost_by_model": m(
        f"""SELECT model, count(*) AS messages, {big('sum(input_tokens)')} AS input_tok,
        {big('sum(output_tokens)')} AS output_tok, {big('sum(cache_read_tokens)')} AS cache_read,
        split_part(model, '-', 2) AS family,
        {usd('''CASE model WHEN 'model-sonnet-1' THEN sum(input_tokens * 3000 + output_tokens * 15000 + cache_read_tokens * 300)
          WHEN 'model-opus-1' THEN sum(input_tokens * 15000 + output_tokens * 75000 + cache_read_tokens * 1500)
          ELSE sum(input_tokens * 250 + output_tokens * 1250 + cache_read_tokens * 25) END''')} AS est_cost_usd
        FROM w_msg GROUP BY model"""
    ),
    "d02_top_prompts": s(
        """SELECT lower(trim(first_prompt)) AS prompt, count(*) AS sessions FROM w_ses
        WHERE first_prompt IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "d03_spend_trend": s(
        f"""SELECT week, cents / 100.0 AS est_cost_usd, (cents - before) / 100.0 AS change_usd,
        {big(ratio('(cents - before)', 'before', 0, True))} AS change_pct,
        CASE WHEN cents > before THEN 'up' WHEN cents < before THEN 'down' WHEN cents = before THEN 'flat' END AS trend
        FROM (SELECT week, cents, lag(cents) OVER (ORDER BY week) AS before
              FROM (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week,
                           CAST((sum(nano) + 5000000) // 10000000 AS BIGINT) AS cents FROM w_ses GROUP BY 1))"""
    ),
    "d04_month_spend": s(
        f"""SELECT count(*) AS sessions, {TOTAL_COST} AS est_cost_usd FROM w_ses
        WHERE created_at >= DATE '2024-01-01' AND created_at < DATE '2024-02-01'"""
    ),
    "d05_abandoned_rate": s(
        f"""SELECT count(*) AS sessions, count(*) FILTER (WHERE message_count <= 3) AS abandoned,
        {ratio('count(*) FILTER (WHERE message_count <= 3)', 'count(*)', 1, True)} AS abandoned_pct
        FROM w_ses WHERE {since('created_at', 30)}"""
    ),
    "d06_sessions_with_tool": s(
        """SELECT session_id, created_at, message_count, tokens FROM w_ses WHERE project_name = 'proj-3'
        AND session_id IN (SELECT session_id FROM w_msg WHERE tool_name = 'purchase')"""
    ),
    "display_formats": s(
        f"""SELECT session_id, {human('total_input_tokens', False)} AS terminal, {human('total_input_tokens', True)} AS web,
        concat('$', CAST(((nano + 5000000) // 10000000) // 100 AS VARCHAR), '.',
               lpad(CAST(((nano + 5000000) // 10000000) % 100 AS VARCHAR), 2, '0')) AS cost,
        substr(concat(session_id, '-', project_name), 1, 20) AS label FROM w_ses"""
    ),
}

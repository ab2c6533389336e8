"""The ingest queries as plain SQL on the given tables, without any JSON in between."""

from __future__ import annotations

EPOCH_MS = 1704067200000


def recs(suffix: str = "", up_to_turn: int | None = None) -> str:
    """Records of the derived transcripts, replays included, one CTE."""
    where = f"WHERE turn <= {up_to_turn}" if up_to_turn is not None else ""
    return f"""
base{suffix} AS (
  SELECT conv_id, turn, role, text, 1 AS factor, (turn // 4) * 100 * 100000 + turn AS pos, (turn // 4) * 100 AS block
  FROM conversations {where}
  UNION ALL
  SELECT conv_id, turn, role, 'again', 2, 1000 * 100000 + turn, 1000 FROM conversations {where}
  {'AND' if where else 'WHERE'} turn % 3 = 1
),
size{suffix} AS (SELECT conv_id, turn, length(text) AS n_chars FROM conversations),
recs{suffix} AS (
  SELECT b.*, CASE WHEN conv_id % 5 = 4
      THEN concat('/src/projects/proj-', CAST(conv_id % 12 AS VARCHAR), '/c', CAST(conv_id - 1 AS VARCHAR), '/subagents/agent-', CAST(conv_id AS VARCHAR), '.jsonl')
      ELSE concat('/src/projects/proj-', CAST(conv_id % 12 AS VARCHAR), '/f', CAST(conv_id AS VARCHAR), '.jsonl') END AS file_path,
    conv_id % 5 = 4 AS sub,
    CASE WHEN conv_id % 5 = 4 THEN concat('agent-', CAST(conv_id AS VARCHAR)) ELSE concat('f', CAST(conv_id AS VARCHAR)) END AS stem,
    {EPOCH_MS} + conv_id * 1000 AS mtime_ms,
    CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN NULL
         ELSE concat('c', CAST(CASE WHEN conv_id % 5 = 3 THEN conv_id - 1 ELSE conv_id END AS VARCHAR)) END AS own,
    concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS uuid,
    CASE WHEN turn > 0 THEN concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn - 1 AS VARCHAR)) END AS parent_uuid,
    CASE WHEN turn % 6 <> 5 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 37 + turn) END AS ts,
    turn % 7 = 6 AS is_sidechain,
    CASE WHEN turn % 2 = 1 THEN concat('model-', CAST(turn % 3 AS VARCHAR)) END AS model,
    CASE WHEN turn % 2 = 1 THEN 'end_turn' END AS stop_reason,
    s.n_chars * factor AS input_tokens, turn AS output_tokens, conv_id % 100 AS cache_read_tokens,
    CASE WHEN turn % 2 = 1 THEN 'text,tool_use' END AS content_types,
    CASE WHEN turn % 4 = 3 THEN '' ELSE CASE turn % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Edit' ELSE 'Bash' END END AS tool_a,
    CASE WHEN turn % 4 = 3 THEN 'Glob' ELSE '' END AS tool_b,
    concat('{{"n":', CAST(turn AS VARCHAR), ',"t":', CAST(to_json(text) AS VARCHAR), '}}') AS input_a,
    CASE WHEN turn % 2 = 1 THEN concat('bare', chr(10), text) END AS text_content,
    CASE WHEN role = 'user' AND turn % 7 <> 6 THEN CASE WHEN turn % 2 = 1 THEN 'bare' ELSE text END END AS prompt
  FROM base{suffix} b JOIN size{suffix} s USING (conv_id, turn)
),
bad{suffix} AS (SELECT file_path, count(*) AS bad_lines FROM recs{suffix} WHERE conv_id % 17 = 16 AND turn = 1 GROUP BY 1),
good{suffix} AS (SELECT * FROM recs{suffix} WHERE file_path NOT IN (SELECT file_path FROM bad{suffix})),
named{suffix} AS (
  SELECT file_path, own, pos AS named_from, concat('/w/', CAST(conv_id AS VARCHAR)) AS cwd,
         concat('1.', CAST(turn AS VARCHAR)) AS version,
         CASE WHEN turn % 2 = 1 THEN concat('b', CAST(turn AS VARCHAR)) END AS git_branch
  FROM good{suffix} WHERE own IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY pos) = 1
),
prompted{suffix} AS (
  SELECT file_path, prompt AS first_prompt FROM good{suffix} WHERE prompt IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY pos) = 1
),
used{suffix} AS (
  SELECT file_path, string_agg(name, ',' ORDER BY name) AS tools_used FROM (
    SELECT DISTINCT file_path, name FROM (
      SELECT file_path, unnest([tool_a, tool_b]) AS name FROM good{suffix} WHERE turn % 2 = 1)) GROUP BY 1
),
files{suffix} AS (
  SELECT CASE WHEN any_value(g.sub) THEN any_value(g.stem) ELSE coalesce(any_value(n.own), any_value(g.stem)) END AS session_id,
    regexp_replace(g.file_path, '/[^/]*$', '') AS project_path,
    concat('proj-', CAST(any_value(conv_id) % 12 AS VARCHAR)) AS project_name,
    any_value(n.git_branch) AS git_branch, any_value(n.version) AS version, any_value(n.cwd) AS cwd,
    min(ts) AS created_at, max(ts) AS modified_at, CAST(count(*) AS INTEGER) AS message_count,
    CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(cache_read_tokens) AS BIGINT) AS total_cache_read, CAST(0 AS BIGINT) AS total_cache_write,
    coalesce(any_value(u.tools_used), '') AS tools_used,
    coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models_used,
    any_value(p.first_prompt) AS first_prompt, g.file_path, any_value(g.sub) AS is_subagent,
    CASE WHEN any_value(g.sub) THEN concat('c', CAST(any_value(conv_id) - 1 AS VARCHAR)) END AS parent_session_id,
    any_value(mtime_ms) AS mtime_ms, any_value(n.named_from) AS named_from
  FROM good{suffix} g LEFT JOIN named{suffix} n USING (file_path) LEFT JOIN prompted{suffix} p USING (file_path)
  LEFT JOIN used{suffix} u USING (file_path)
  GROUP BY g.file_path
),
owned{suffix} AS (
  SELECT g.*, f.session_id AS owner, CASE WHEN g.sub OR g.pos >= f.named_from THEN f.session_id ELSE g.stem END AS session_id
  FROM good{suffix} g JOIN files{suffix} f USING (file_path)
),
msgs{suffix} AS (
  SELECT * FROM owned{suffix}
  QUALIFY row_number() OVER (PARTITION BY file_path, session_id, uuid ORDER BY pos DESC) = 1
)"""


def t(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


TOOL_NAME = "CASE WHEN turn % 2 = 1 THEN CASE WHEN tool_a <> '' THEN tool_a ELSE tool_b END END AS tool_name"
SUMMARY = "CASE WHEN turn % 2 = 1 THEN CASE WHEN tool_a <> '' THEN input_a ELSE '{}' END END AS tool_input_summary"
TYPES = "content_types"

ROLLUP = f"""{t('created_at')} AS created_at, {t('modified_at')} AS modified_at, message_count, total_input_tokens,
  total_output_tokens, total_cache_read, total_cache_write, tools_used, models_used, first_prompt"""

CALLS = f"""
calls AS (
  SELECT file_path, session_id, uuid AS message_uuid, tool_a AS tool_name, input_a AS tool_input, ts, 2 AS idx, owner
  FROM msgs WHERE turn % 2 = 1
  UNION ALL SELECT file_path, session_id, uuid, tool_b, '{{}}', ts, 3, owner FROM msgs WHERE turn % 2 = 1
)"""

# Both syncs: the files up to turn 2 as batch 1, the whole files as batch 2.
TWO = f"{recs('1', 2)},{recs('')}"
VERSIONS = """
versions AS (SELECT 1 AS batch, * FROM files1 UNION ALL SELECT 2, * FROM files),
firsts AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY batch, mtime_ms, file_path) = 1),
lasts AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY batch DESC, mtime_ms DESC, file_path DESC) = 1)"""
MERGED = f"""WITH {TWO}, {VERSIONS}
  SELECT session_id, f.project_name, f.version, f.cwd, {t('f.created_at')} AS created_at, {t('l.modified_at')} AS modified_at,
    l.message_count, l.total_input_tokens, l.tools_used, l.first_prompt, f.file_path, f.is_subagent
  FROM firsts f JOIN lasts l USING (session_id)"""
MESSAGES = f"""file_path, session_id, uuid, parent_uuid, role AS type, {t('ts')} AS timestamp, input_tokens,
  {TYPES}, {TOOL_NAME}, {SUMMARY}, text_content"""

LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"

PLACED = f"""(SELECT concat('/src/', source, '.txt') AS file_path, doc_id, CAST(i AS INTEGER) AS i, line,
    CAST(strlen(line) + 1 AS BIGINT) AS size,
    CAST(sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY doc_id, i) AS BIGINT) AS end_offset FROM {LINES})"""

HOOKS = """
h AS (
  SELECT event_id, user_id, event_type, ts, props,
    concat('/src/logs/', CASE event_type WHEN 'signup' THEN 'sessionstart' WHEN 'purchase' THEN 'posttooluse'
      WHEN 'view' THEN 'pretooluse' WHEN 'click' THEN 'notification' ELSE 'ensure-stop' END, '.log') AS file_path
  FROM events
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY event_id) AS n
  FROM h WHERE event_id % 11 <> 0
),
last_ids AS (SELECT file_path, max(user_id) AS last_id FROM h GROUP BY 1)"""

ORACLE = {
    "i02_split_feeds": f"""WITH {recs()}
      SELECT CASE WHEN sub THEN 'subagents' ELSE 'sessions' END AS feed, regexp_replace(file_path, '/[^/]*$', '') AS folder,
        CAST(sum(CASE WHEN factor = 2 THEN 1 WHEN turn % 4 IN (2, 3) THEN 2 ELSE 1 END) AS BIGINT) AS lines
      FROM recs GROUP BY 1, 2""",
    "i03_line_numbers": f"""SELECT concat('/src/', source, '.txt') AS file_path, doc_id, CAST(i AS INTEGER) AS i,
        row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line_no FROM {LINES}""",
    "i03_line_offsets": f"SELECT file_path, doc_id, i, end_offset, end_offset - size AS \"offset\" FROM {PLACED}",
    "i24_log_tail": f"""SELECT file_path, doc_id, i, end_offset, end_offset - size AS "offset", line
      FROM {PLACED} WHERE end_offset - size >= 20000""",
    "i04_parsed_records": f"""WITH {recs()}
      SELECT file_path, block, uuid, parent_uuid, role AS type, {t('ts')} AS timestamp, is_sidechain, role, model, stop_reason,
        input_tokens, output_tokens, cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens, {TYPES}, {TOOL_NAME}, {SUMMARY},
        text_content, prompt
      FROM recs WHERE NOT (conv_id % 17 = 16 AND turn = 1)""",
    "i05_quarantined_files": f"""WITH {recs()}
      SELECT file_path, 'message not an object' AS reason, bad_lines, 'file' AS scope FROM bad""",
    "i05_good_records": f"WITH {recs()} SELECT file_path, count(*) AS records FROM good GROUP BY 1",
    "i06_session_identity": f"""WITH {recs()}
      SELECT session_id, project_path, project_name, git_branch, version, cwd, file_path, is_subagent, parent_session_id FROM files""",
    "i17_session_rollup": f"WITH {recs()} SELECT file_path, {ROLLUP} FROM files",
    "i18_messages": f"WITH {recs()} SELECT {MESSAGES} FROM msgs",
    "i19_tool_calls": f"""WITH {recs()}, {CALLS}
      SELECT file_path, session_id, message_uuid, tool_name, tool_input, {t('ts')} AS timestamp, idx FROM calls""",
    "i20_merged_sessions": MERGED,
    "i21_replaced_messages": f"""WITH {TWO}, {VERSIONS},
      pair AS (SELECT 1 AS batch, * FROM msgs1 UNION ALL SELECT 2, * FROM msgs)
      SELECT m.session_id, uuid, role AS type, {t('ts')} AS timestamp, input_tokens, text_content
      FROM pair m JOIN lasts l ON m.owner = l.session_id AND m.batch = l.batch AND m.file_path = l.file_path""",
    "i23_deleted_sessions": f"""SELECT concat('d', CAST(doc_id AS VARCHAR), '-', CAST(i AS VARCHAR)) AS session_id,
        concat('/orig/', source) AS project_path, CAST(doc_id_own AS VARCHAR) AS project_name, lang AS git_branch,
        '2024-01-02 03:04:05' AS created_at, CAST(NULL AS VARCHAR) AS modified_at,
        CAST(CASE WHEN i % 3 <> 0 THEN i ELSE 0 END AS INTEGER) AS message_count,
        line AS first_prompt, line AS summary
      FROM (SELECT doc_id AS doc_id_own, doc_id - doc_id % 2 AS doc_id, source, lang, line, i FROM {LINES} WHERE i % 2 = 0)
      QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY doc_id_own) = 1""",
    "i25_hook_events": f"""WITH {HOOKS}
      SELECT last_id + n AS id, CASE event_type WHEN 'signup' THEN 'SessionStart' WHEN 'purchase' THEN 'PostToolUse'
          WHEN 'view' THEN 'PreToolUse' WHEN 'click' THEN 'Notification' ELSE 'EnsureStop' END AS event_type,
        CASE WHEN event_id % 5 <> 0 THEN concat('u', CAST(user_id AS VARCHAR)) END AS session_id, {t('ts')} AS timestamp,
        CASE WHEN event_id % 5 <> 0 THEN '/w' END AS cwd, CASE WHEN event_id % 5 <> 0 THEN event_type END AS tool_name,
        CASE WHEN event_id % 5 IN (3, 4)
          THEN concat('{{"k":', regexp_extract(props, '(\\d+)', 1), ',"t":"', event_type, '"}}') END AS tool_input, file_path
      FROM numbered JOIN last_ids USING (file_path) WHERE event_id % 13 <> 0 AND event_id % 5 <> 1""",
    "i25_hook_rejects": f"""WITH {HOOKS}
      SELECT file_path, 'payload is JSON but not an object' AS reason, count(*) AS lines
      FROM numbered WHERE event_id % 13 <> 0 AND event_id % 5 = 1 GROUP BY 1""",
    "i27_todos": f"""SELECT concat('d', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '-agent-x.json' ELSE '.json' END) AS file_name,
        CAST(i AS INTEGER) AS idx, concat('d', CAST(doc_id AS VARCHAR)) AS session_id, line AS content,
        CASE WHEN i % 2 = 0 THEN 'done' END AS status, lang AS active_form
      FROM {LINES} WHERE doc_id % 3 <> 0""",
    "i28_debug_logs": """SELECT concat('/src/debug/d', CAST(doc_id AS VARCHAR), '.txt') AS file_path, concat('d', CAST(doc_id AS VARCHAR)) AS session_id,
        CASE WHEN doc_id % 2 = 0 AND doc_id % 9 <> 0 THEN '2024-01-02 03:04:05' END AS timestamp,
        CASE WHEN doc_id % 9 <> 0 THEN trim(concat(CASE WHEN doc_id % 2 = 0 THEN '2024-01-02T03:04:05.5Z  ' ELSE '' END, string_split(text, chr(10))[1]),
          concat(' ', chr(9), chr(13))) ELSE '' END AS first_line,
        CAST(CASE WHEN doc_id % 9 <> 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS INTEGER) AS line_count,
        CAST(CASE WHEN doc_id % 9 <> 0 THEN strlen(text) ELSE 0 END AS BIGINT) AS size_bytes
      FROM documents""",
    "i29_history": """SELECT concat('/src/history/', CASE WHEN doc_id % 7 <> 0 THEN concat(source, '/') ELSE '' END,
          CASE WHEN doc_id % 2 = 0 THEN concat('20240102T03', lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), '05_note_', lang, '_on-', CAST(doc_id AS VARCHAR), '-x.md')
               ELSE concat('free-', CAST(doc_id AS VARCHAR), '.md') END) AS file_path,
        CASE WHEN doc_id % 7 <> 0 THEN source ELSE 'uncategorized' END AS category, lang AS agent,
        CASE WHEN doc_id % 2 = 0 THEN concat('2024-01-02 03:', lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), ':05') ELSE '2024-01-02 03:04:05' END AS timestamp,
        CASE WHEN doc_id % 2 = 0 THEN concat('on ', CAST(doc_id AS VARCHAR), ' x') ELSE concat('free-', CAST(doc_id AS VARCHAR)) END AS description,
        concat(CASE WHEN doc_id % 2 = 1 THEN concat('agent: ', lang, chr(10), 'timestamp: 2024-01-02T03:04:05Z', chr(10)) ELSE '' END,
          'grown', chr(10), text) AS content
      FROM documents""",
    "i32_sync_state": f"""WITH {TWO}
      SELECT CASE WHEN sub THEN 'subagents' ELSE 'sessions' END AS source_name, max(mtime_ms) AS last_mtime_ms,
        CAST(2 * count(DISTINCT file_path) AS INTEGER) AS files_synced, any_value(n) AS rows_synced,
        '2024-01-31 00:00:00' AS last_run
      FROM recs JOIN (SELECT sub AS s, CAST(sum(k) AS BIGINT) AS n FROM (
        SELECT is_subagent AS sub, message_count AS k FROM files1 UNION ALL SELECT is_subagent, message_count FROM files) GROUP BY 1) ON s = sub
      GROUP BY sub""",
    "i36_purge_candidates": f"""WITH {recs()}
      SELECT CASE WHEN mtime_ms > {EPOCH_MS} + 60000 THEN 'recent' WHEN file_path IN (SELECT file_path FROM files) THEN 'purgeable'
          ELSE 'unsynced' END AS class, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
      FROM (SELECT file_path, any_value(mtime_ms) AS mtime_ms,
              sum((CASE WHEN factor = 2 THEN 1 WHEN turn % 4 IN (2, 3) THEN 2 ELSE 1 END) * (input_tokens // factor)) AS bytes
            FROM recs GROUP BY 1) GROUP BY 1""",
    "i37_compacted_tool_calls": f"""WITH {TWO}, {VERSIONS}, {CALLS}
      SELECT c.session_id, message_uuid, tool_name, tool_input, {t('ts')} AS timestamp, idx
      FROM calls c JOIN lasts l ON c.owner = l.session_id AND c.file_path = l.file_path AND l.batch = 2""",
    "i38_synced_sessions": MERGED,
}

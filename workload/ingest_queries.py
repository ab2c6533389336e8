"""Ingest rules over source files derived from the given tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import merge, numbering, purge, records, sidefeeds
from tracewell.plans.sync import load_transcripts
from tracewell.plans.warehouse import SourceState, Warehouse
from tracewell.session import scratch_dir
from tracewell.sources import files
from tracewell.sources.transcripts import split_feeds
from workload import ingest_sources as src

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
EARLIER_TURN = 2
TAIL_START = 20_000


def flat(df: DataFrame) -> DataFrame:
    """Times and lists as text, for comparison."""
    out = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind.startswith("array"):
            out.append(F.array_join(name, ",").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _parsed(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return records.parse_records(src.transcript_lines(spark, sf, **kw))


def _staged(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Parsed once and written as columns, as `sync` does: later steps read the columns they need."""
    path = scratch_dir(spark, "records")
    _parsed(spark, sf, **kw).write.parquet(path)
    return spark.read.parquet(path)


def split_by_feed(spark, sf):
    main, sub = split_feeds(src.transcript_lines(spark, sf))
    both = main.withColumn("feed", F.lit("sessions")).unionByName(sub.withColumn("feed", F.lit("subagents")))
    return both.groupBy("feed", files.parent_path(F.col("file_path")).alias("folder")).agg(F.count("*").alias("lines"))


def line_numbers(spark, sf):
    return numbering.number_lines(src.document_lines(spark, sf)).select("file_path", "doc_id", "i", "line_no")


def line_offsets(spark, sf):
    return numbering.byte_offsets(src.document_lines(spark, sf)).select(
        "file_path", "doc_id", "i", "offset", "end_offset"
    )


def log_tail(spark, sf):
    """Lines that start at or after a position in their file, as after an earlier read."""
    tail = numbering.byte_offsets(src.document_lines(spark, sf), F.lit(TAIL_START))
    return tail.select("file_path", "doc_id", "i", "offset", "end_offset", F.col("value").alias("line"))


def parsed_records(spark, sf):
    good = _parsed(spark, sf).where(F.col("reason").isNull())
    return flat(
        good.select(
            "file_path", F.col("pos.block_start").alias("block"), "uuid", "parent_uuid", "type", "timestamp",
            "is_sidechain", "role", "model", "stop_reason", "input_tokens", "output_tokens", "cache_read_tokens",
            "cache_write_tokens", "content_types", "tool_name", "tool_input_summary", "text_content", "prompt",
        )
    )


def quarantined(spark, sf):
    return records.quarantine(_parsed(spark, sf))[1]


def good_records(spark, sf):
    good, _ = records.quarantine(_parsed(spark, sf))
    return good.groupBy("file_path").agg(F.count("*").alias("records"))


def session_identity(spark, sf):
    return records.summarize_files(_parsed(spark, sf)).select(
        "session_id", "project_path", "project_name", "git_branch", "version", "cwd", "file_path", "is_subagent", "parent_session_id"
    )


def session_rollup(spark, sf):
    return flat(
        records.summarize_files(_parsed(spark, sf)).select(
            "file_path", "created_at", "modified_at", "message_count", "total_input_tokens", "total_output_tokens",
            "total_cache_read", "total_cache_write", "tools_used", "models_used", "first_prompt",
        )
    )


def messages(spark, sf):
    parsed = _staged(spark, sf)
    rows = records.messages_of(parsed, records.summarize_files(parsed))
    return flat(
        rows.select(
            "file_path", "session_id", "uuid", "parent_uuid", "type", "timestamp", "input_tokens", "content_types",
            "tool_name", "tool_input_summary", "text_content",
        )
    )


def tool_calls(spark, sf):
    parsed = _staged(spark, sf)
    rows = records.tool_calls_of(parsed, records.summarize_files(parsed))
    return flat(rows.select("file_path", "session_id", "message_uuid", "tool_name", "tool_input", "timestamp", "idx"))


def _logs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Session and message logs after two syncs: of the files as they were, and as they are."""
    sessions, msgs = [], []
    for batch, turn in ((1, EARLIER_TURN), (2, None)):
        parsed = _staged(spark, sf, up_to_turn=turn)
        loaded = records.summarize_files(parsed)
        for rows, log in ((loaded, sessions), (records.messages_of(parsed, loaded), msgs)):
            log.append(
                rows.withColumn("source_path", F.col("file_path")).withColumn("seq_batch", F.lit(batch).cast("bigint"))
            )
    return reduce(DataFrame.unionByName, sessions), reduce(DataFrame.unionByName, msgs)


SESSION_COLUMNS = [
    "session_id", "project_name", "version", "cwd", "created_at", "modified_at", "message_count", "total_input_tokens",
    "tools_used", "first_prompt", "file_path", "is_subagent",
]


def merged_sessions(spark, sf):
    return flat(merge.merge_sessions(_logs(spark, sf)[0]).select(*SESSION_COLUMNS))


def replaced_messages(spark, sf):
    sessions, msgs = _logs(spark, sf)
    current = merge.replace_children(msgs, merge.winning_versions(sessions, "session_id"))
    return flat(current.select("session_id", "uuid", "type", "timestamp", "input_tokens", "text_content"))


def _synced(spark, sf, compact_between: bool = False) -> Warehouse:
    """The same two syncs, written and committed."""
    wh = Warehouse(spark, scratch_dir(spark, "tables"))
    state: dict[str, SourceState] = {}
    for turn in (EARLIER_TURN, None):
        lines = src.transcript_lines(spark, sf, up_to_turn=turn)
        loaded, rejects = load_transcripts(wh, lines)
        wh.write("_rejects", rejects)
        seen = lines.groupBy(files.is_subagent(F.col("file_path")).alias("sub")).agg(
            F.countDistinct("file_path").alias("n"), F.max("mtime_ms").alias("newest")
        )
        rows = {r.is_subagent: r.rows for r in loaded.groupBy("is_subagent").agg(F.sum("message_count").alias("rows")).collect()}
        for r in seen.collect():
            source = "subagents" if r.sub else "sessions"
            old = state.get(source, SourceState())
            state[source] = old.advanced(r.n, rows.get(r.sub, 0), NOW, mtime_ms=r.newest)
        wh.commit(state)
        if compact_between and turn is not None:
            wh.compact()
    return wh


def synced_sessions(spark, sf):
    return flat(_synced(spark, sf, compact_between=True).table("sessions").select(*SESSION_COLUMNS))


def sync_state(spark, sf):
    state = _synced(spark, sf).state_table()
    return flat(state.select("source_name", "last_mtime_ms", "files_synced", "rows_synced", "last_run"))


def compacted_calls(spark, sf):
    wh = _synced(spark, sf)
    wh.compact()
    return flat(wh.table("tool_calls"))


def deleted(spark, sf):
    entries, _ = sidefeeds.index_entries(src.index_files(spark, sf))
    gone = sidefeeds.deleted_sessions(entries, src.index_present(spark, sf))
    log = gone.withColumnRenamed("file_path", "source_path").withColumn("seq_batch", F.lit(1))
    columns = ["project_path", "project_name", "git_branch", "created_at", "modified_at", "message_count", "first_prompt", "summary"]
    return flat(
        merge.insert_if_absent(log, "session_id", columns, [*merge.SEQ, "entry_idx"]).select("session_id", *columns)
    )


def hook_events(spark, sf):
    lines = src.hook_lines(spark, sf)
    last_ids = lines.groupBy("file_path").agg(F.max("user_id").alias("last_id"))
    return flat(sidefeeds.number_events(sidefeeds.parse_hook_lines(lines), last_ids)[0])


def hook_rejects(spark, sf):
    lines = src.hook_lines(spark, sf)
    last_ids = lines.groupBy("file_path").agg(F.max("user_id").alias("last_id"))
    rejects = sidefeeds.number_events(sidefeeds.parse_hook_lines(lines), last_ids)[1]
    return rejects.groupBy("file_path", "reason").agg(F.count("*").alias("lines"))


def todos(spark, sf):
    log = (
        sidefeeds.todo_items(src.todo_files(spark, sf))
        .withColumn("seq_batch", F.lit(1))
        .unionByName(sidefeeds.todo_items(src.todo_files(spark, sf, emptied=True)).withColumn("seq_batch", F.lit(2)))
    )
    return merge.replace_by_file(log).select("file_name", "idx", "session_id", "content", "status", "active_form")


def debug_logs(spark, sf):
    """Over two batches: the first lines alone, then whole logs under another first line; every ninth log stays empty."""
    log = None
    for batch, grown in ((1, False), (2, True)):
        stats = sidefeeds.debug_log_stats(src.debug_lines(spark, sf, grown), src.debug_files(spark, sf, grown))
        stats = stats.withColumn("source_path", F.col("file_path")).withColumn("seq_batch", F.lit(batch).cast("bigint"))
        log = stats if log is None else log.unionByName(stats)
    kept, replaced = ["session_id", "timestamp", "first_line"], ["line_count", "size_bytes"]
    return flat(merge.fold(log, "file_path", kept, replaced).select("file_path", *kept, *replaced))


def history(spark, sf):
    log = None
    for batch, grown in ((1, False), (2, True)):
        notes = sidefeeds.history_notes(src.note_files(spark, sf, grown), "/src/history")
        notes = notes.withColumn("source_path", F.col("file_path")).withColumn("seq_batch", F.lit(batch))
        log = notes if log is None else log.unionByName(notes)
    kept = ["category", "agent", "timestamp", "description"]
    return flat(merge.fold(log, "file_path", kept, ["content"]).select("file_path", *kept, "content"))


def purge_classes(spark, sf):
    sessions = records.summarize_files(_parsed(spark, sf))
    newest = src.EPOCH_MS / 1000 + 7 * 86400 + 60
    as_of = dt.datetime.fromtimestamp(newest, dt.timezone.utc)
    return purge.purge_candidates(src.transcript_files(spark, sf), sessions, as_of)


QUERIES = {
    "i02_split_feeds": split_by_feed,
    "i03_line_numbers": line_numbers,
    "i03_line_offsets": line_offsets,
    "i04_parsed_records": parsed_records,
    "i05_quarantined_files": quarantined,
    "i05_good_records": good_records,
    "i06_session_identity": session_identity,
    "i17_session_rollup": session_rollup,
    "i18_messages": messages,
    "i19_tool_calls": tool_calls,
    "i20_merged_sessions": merged_sessions,
    "i21_replaced_messages": replaced_messages,
    "i23_deleted_sessions": deleted,
    "i24_log_tail": log_tail,
    "i25_hook_events": hook_events,
    "i25_hook_rejects": hook_rejects,
    "i27_todos": todos,
    "i28_debug_logs": debug_logs,
    "i29_history": history,
    "i32_sync_state": sync_state,
    "i36_purge_candidates": purge_classes,
    "i37_compacted_tool_calls": compacted_calls,
    "i38_synced_sessions": synced_sessions,
}

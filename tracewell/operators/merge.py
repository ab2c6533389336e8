"""Reading append-only logs as tables.

Every sync appends the new version of what it read. A version is ordered by
``SEQ``: batch, then modification time, then path of the source file. Tables
are folded from the log when read, or once and for all by compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ = ["seq_batch", "mtime_ms", "source_path"]

# Columns of a session that a later sync replaces; the others keep their first value.
SESSION_UPDATED = [
    "modified_at", "message_count", "total_input_tokens", "total_output_tokens", "total_cache_read",
    "total_cache_write", "tools_used", "models_used", "first_prompt",
]
SESSION_KEPT = [
    "project_path", "project_name", "git_branch", "version", "cwd", "created_at", "file_path", "is_subagent",
    "parent_session_id",
]


def fold(
    log: DataFrame, key: str, first: list[str], last: list[str], order: list[str] = SEQ
) -> DataFrame:
    """One row per key: ``first`` columns of its first version, ``last`` columns of its latest.

    Columns travel as structs, so a NULL of the chosen version stays. The row
    carries the order columns of the latest version and can be folded again.
    """
    seq = F.struct(*order)
    parts = [F.max(seq).alias("s")]
    if first:
        parts.append(F.min_by(F.struct(*first), seq).alias("f"))
    if last:
        parts.append(F.max_by(F.struct(*last), seq).alias("l"))
    return log.groupBy(key).agg(*parts).select(
        key, *(["f.*"] if first else []), *(["l.*"] if last else []), "s.*"
    )


def merge_sessions(log: DataFrame) -> DataFrame:
    return fold(log, "session_id", SESSION_KEPT, SESSION_UPDATED)


def winning_versions(log: DataFrame, key: str) -> DataFrame:
    """The latest version of each key."""
    return log.groupBy(key).agg(F.max(F.struct(*SEQ)).alias("s")).select(key, "s.*")


def replace_children(children: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows of the file version that owns its session now; of two files with one session the later one."""
    owners = winners.select(F.col("session_id").alias("owner_session_id"), *SEQ)
    return children.join(owners, ["owner_session_id", *SEQ], "left_semi")


def replace_by_file(rows: DataFrame) -> DataFrame:
    """Rows of the latest version of each file; a version without items is one row with idx NULL."""
    latest = winning_versions(rows, "file_name")
    return rows.join(latest, ["file_name", *SEQ], "left_semi").where(F.col("idx").isNotNull())


def insert_if_absent(log: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first version of each key, whole."""
    return fold(log, key, columns, [], order)

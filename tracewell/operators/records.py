"""From transcript lines to records, sessions, messages and tool calls.

``parse_records`` is one narrow pass over the lines. Everything a file decides
for its rows (which session they belong to, whether the file is readable at
all) is one row per file from a partial aggregation, joined back by path, so no
step gathers the rows of a file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import times
from tracewell.functions import variants as V
from tracewell.sources import files

USAGE = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_read_tokens": "cache_read_input_tokens",
    "cache_write_tokens": "cache_creation_input_tokens",
}
TOP = (
    "type", "uuid", "parentUuid", "sessionId", "cwd", "version", "gitBranch", "timestamp", "isSidechain",
)
SNAPSHOT = "file-history-snapshot"


def _bad_number(value: Column) -> Column:
    """A token count that cannot be added up; the absent-like values count as 0."""
    kind = F.schema_of_variant(value)
    wrong = kind.rlike("^(STRING|OBJECT|ARRAY)") & V.is_truthy(value)
    return F.coalesce(wrong, F.lit(False))


def parse_records(lines: DataFrame, include_string_content: bool = False) -> DataFrame:
    """One row per kept record, and one with a ``reason`` per line that spoils its file.

    Blank lines, malformed JSON, snapshots and records without uuid are dropped.
    ``include_string_content`` also makes plain string content searchable.
    """
    readable = F.is_valid_utf8("value")

    def is_kept(x: Column) -> Column:
        record = ~V.text(x["r"]["type"]).eqNullSafe(SNAPSHOT) & V.is_truthy(x["r"]["uuid"])
        return ~readable | (x["doc"].isNotNull() & (x["r"].isNull() | record))

    def kind(b: Column) -> Column:
        return F.when(b["o"]["type"].isNull(), F.lit("")).otherwise(V.text(b["o"]["type"]))

    def is_text(b: Column) -> Column:
        return F.when(b["o"].isNotNull(), kind(b).eqNullSafe("text")).otherwise(V.is_string(b["raw"]))

    def block_text(b: Column) -> Column:
        return F.when(b["o"].isNotNull(), F.coalesce(V.text(b["o"]["text"]), F.lit(""))).otherwise(V.text(b["raw"]))

    def tool(b: Column) -> Column:
        name = F.when(b["o"]["name"].isNull(), F.lit("")).otherwise(V.text(b["o"]["name"]))
        given = F.when(b["o"]["input"].isNull(), F.lit("{}")).otherwise(V.json_text(b["o"]["input"]))
        return F.struct(b["idx"].alias("idx"), name.alias("name"), given.alias("input"))

    def is_tool(b: Column) -> Column:
        return b["o"].isNotNull() & kind(b).eqNullSafe("tool_use")

    def spoiled(b: Column) -> Column:
        bad_text = kind(b).eqNullSafe("text") & b["o"]["text"].isNotNull() & ~V.is_string(b["o"]["text"])
        bad_name = is_tool(b) & F.coalesce(V.is_nested(b["o"]["name"]), F.lit(False))
        return b["o"].isNotNull() & (bad_text | bad_name)

    def top(doc: Column) -> Column:
        return F.struct(doc.alias("doc"), V.fields(doc, *TOP, path=V.ROOT).alias("r"))

    def block(b: Column, i: Column) -> Column:
        return F.struct(i.alias("idx"), V.fields(b, "type", "text", "name", "input").alias("o"), b.alias("raw"))

    def parts(x: Column) -> Column:
        doc, message = x["doc"], f"{V.ROOT}.message"
        return F.struct(
            doc.alias("doc"),
            x["r"].alias("r"),
            V.fields(doc, "role", "model", "stop_reason", path=message).alias("m"),
            V.fields(doc, *USAGE.values(), path=f"{message}.usage").alias("u"),
            F.transform(V.elements(doc, f"{message}.content"), block).alias("blocks"),
        )

    def columns(x: Column) -> Column:
        # absent is fine, there but no object is not
        def wrong(found: Column, path: str) -> Column:
            return F.when(found.isNull(), V.value_at(x["doc"], path).isNotNull()).otherwise(False)

        content = V.value_at(x["doc"], f"{V.ROOT}.message.content")
        return F.struct(
            x["r"].alias("r"),
            x["m"].alias("m"),
            x["u"].alias("u"),
            wrong(x["m"], f"{V.ROOT}.message").alias("bad_message"),
            wrong(x["u"], f"{V.ROOT}.message.usage").alias("bad_usage"),
            F.array_distinct(F.transform(F.filter(x["blocks"], lambda b: b["o"].isNotNull()), kind)).alias("types"),
            F.transform(F.filter(x["blocks"], is_text), block_text).alias("texts"),
            F.transform(F.filter(x["blocks"], is_tool), tool).alias("tool_uses"),
            F.exists(x["blocks"], spoiled).alias("spoiled"),
            F.when(x["blocks"].isNull(), F.when(V.is_string(content), V.text(content))).alias("string_content"),
        )

    # One list of at most one record per line, taken apart step by step below the
    # generator, so that nothing is parsed or looked up twice.
    records = F.filter(F.transform(V.documents(F.col("value")), top), is_kept)
    nested = lines.select(
        "file_path",
        "mtime_ms",
        F.struct("block_start", "line_id").alias("pos"),
        readable.alias("readable"),
        F.explode(F.transform(F.transform(records, parts), columns)).alias("x"),
    ).select("file_path", "mtime_ms", "pos", "readable", "x.*")

    tool_uses = F.col("tool_uses")
    named = F.filter(tool_uses, lambda t: t["name"] != "")
    first_tool = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(tool_uses, F.lit(-1)))
    texts = F.col("texts")
    sidechain = F.when(F.col("r.isSidechain").isNull(), F.lit(False)).otherwise(
        F.try_variant_get("r.isSidechain", "$", "boolean")
    )
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    if include_string_content:
        joined = F.coalesce(joined, F.col("string_content"))
    prompt = F.when(
        V.text(F.col("r.type")).eqNullSafe("user") & ~F.coalesce(sidechain, F.lit(False)),
        F.coalesce(F.try_element_at(texts, F.lit(1)), F.col("string_content")),
    )
    msg_type = F.when(F.col("r.type").isNull(), F.lit("")).otherwise(V.text(F.col("r.type")))
    reason = (
        F.when(~F.col("readable"), "invalid utf-8")
        .when(F.col("r").isNull(), "not an object")
        .when(V.is_nested(F.col("r.uuid")), "uuid not a scalar")
        .when(F.col("bad_message"), "message not an object")
        .when(F.col("bad_usage"), "usage not an object")
        .when(F.coalesce(V.is_nested(F.col("m.model")) & V.is_truthy(F.col("m.model")), F.lit(False)), "model not a scalar")
    )
    for field in USAGE.values():
        reason = reason.when(_bad_number(F.col(f"u.{field}")), f"{field} not a number")
    reason = reason.when(F.col("spoiled"), "text or tool name of wrong type")

    return nested.select(
        "file_path",
        "mtime_ms",
        "pos",
        reason.alias("reason"),
        V.text(F.col("r.sessionId")).alias("own_session_id"),
        V.text(F.col("r.cwd")).alias("cwd"),
        V.text(F.col("r.version")).alias("version"),
        V.text(F.col("r.gitBranch")).alias("git_branch"),
        V.text(F.col("r.uuid")).alias("uuid"),
        V.text(F.col("r.parentUuid")).alias("parent_uuid"),
        msg_type.alias("type"),
        times.parse_iso(V.text(F.col("r.timestamp"))).alias("timestamp"),
        sidechain.alias("is_sidechain"),
        V.text(F.col("m.role")).alias("role"),
        V.text(F.col("m.model")).alias("model"),
        V.text(F.col("m.stop_reason")).alias("stop_reason"),
        *(
            F.coalesce(F.try_variant_get(f"u.{source}", "$", "bigint"), F.lit(0)).alias(name)
            for name, source in USAGE.items()
        ),
        F.when(F.size("types") > 0, F.col("types")).alias("content_types"),
        first_tool["name"].alias("tool_name"),
        first_tool["input"].alias("tool_input_summary"),
        joined.alias("text_content"),
        prompt.alias("prompt"),
        F.coalesce(tool_uses, F.array()).alias("tool_uses"),
    )


def quarantine(records: DataFrame, on_error: str = "file") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): one bad line rejects its whole file, or only itself with ``on_error="line"``."""
    if on_error not in ("file", "line"):
        raise ValueError("on_error is 'file' or 'line'")
    bad = records.where(F.col("reason").isNotNull())
    rejected = bad.groupBy("file_path").agg(F.min("reason").alias("reason"), F.count("*").alias("bad_lines"))
    good = records.where(F.col("reason").isNull())
    if on_error == "file":
        good = good.join(rejected.select("file_path"), "file_path", "left_anti")
    return good, rejected.withColumn("scope", F.lit(on_error))


def summarize_files(records: DataFrame, on_error: str = "file") -> DataFrame:
    """One row per loaded file: its session with all totals, before any deduplication.

    The first record with a session id names the session and carries cwd,
    version and branch; rows before it keep the file stem (``named_from``).
    Subagent files always go by their stem.
    """
    ok = F.col("reason").isNull()
    names = ok & (F.coalesce(F.col("own_session_id"), F.lit("")) != "")
    identity = F.struct("own_session_id", "cwd", "version", "git_branch")
    no_names = F.array().cast("array<string>")
    tool_names = F.array_distinct(F.filter(F.col("tool_uses.name"), lambda n: n.isNotNull()))
    # each record once without a tool, then once per tool it names: sets hold single names, not lists of them
    named = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.when(ok, tool_names), no_names))
    rows = records.withColumn("tool", F.explode(named))
    once = ok & F.col("tool").isNull()

    def total(name: str) -> Column:
        return F.sum(F.when(once, F.col(name)))

    per_file = rows.groupBy("file_path", "mtime_ms").agg(
        F.min("reason").alias("reason"),
        F.count_if(once).alias("kept"),
        F.min_by(identity, F.when(names, F.col("pos"))).alias("ident"),
        F.min(F.when(names, F.col("pos"))).alias("named_from"),
        F.min(F.when(ok, F.col("timestamp"))).alias("created_at"),
        F.max(F.when(ok, F.col("timestamp"))).alias("modified_at"),
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        total("cache_read_tokens").alias("total_cache_read"),
        total("cache_write_tokens").alias("total_cache_write"),
        F.collect_set("tool").alias("tools"),
        F.collect_set(F.when(ok & (F.col("model") != ""), F.col("model"))).alias("models"),
        F.min_by("prompt", F.when(ok & F.col("prompt").isNotNull(), F.col("pos"))).alias("first_prompt"),
    )
    loaded = per_file.where(F.col("kept") > 0)
    if on_error == "file":
        loaded = loaded.where(F.col("reason").isNull())
    path = F.col("file_path")
    sub = files.is_subagent(path)
    stem = files.stem_of(path)
    above = files.ancestor(path, 2)
    return loaded.select(
        F.when(sub, stem).otherwise(F.coalesce(F.col("ident.own_session_id"), stem)).alias("session_id"),
        files.parent_path(path).alias("project_path"),
        F.when(sub, files.ancestor(path, 3)).otherwise(files.ancestor(path, 1)).alias("project_name"),
        F.col("ident.git_branch").alias("git_branch"),
        F.col("ident.version").alias("version"),
        F.col("ident.cwd").alias("cwd"),
        "created_at",
        "modified_at",
        F.col("kept").cast("int").alias("message_count"),
        "total_input_tokens",
        "total_output_tokens",
        "total_cache_read",
        "total_cache_write",
        F.array_sort("tools").alias("tools_used"),
        F.array_sort("models").alias("models_used"),
        "first_prompt",
        "file_path",
        sub.alias("is_subagent"),
        F.when(sub & (above != "subagents"), above).alias("parent_session_id"),
        "mtime_ms",
        "named_from",
    )


def last_per_key(df: DataFrame, keys: list[str], at: list[str], order: str = "pos") -> DataFrame:
    """The last row per key. Which one that is, narrow columns tell: a hash aggregation over keys and places, map side first.
    Wide rows then move once, to their own place; `at` and the order are what tells rows of different keys apart.
    """
    place = (F.col(f"{order}.block_start").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(f"{order}.line_id")).cast("decimal(38,0)")
    placed = df.withColumn("place", place)
    last = placed.groupBy(*keys).agg(F.max("place").alias("place")).select(*at, "place")
    return placed.join(last, [*at, "place"], "left_semi").drop("place", order)


def _owned(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Good records with the session they belong to and the one that owns their file."""
    owner = sessions.select(
        "file_path", F.col("session_id").alias("owner_session_id"), "named_from", "is_subagent"
    )
    stem = files.stem_of(F.col("file_path"))
    late = F.col("is_subagent") | (F.col("pos") >= F.col("named_from"))
    return (
        records.where(F.col("reason").isNull())
        .join(owner, "file_path")
        .withColumn("session_id", F.when(F.coalesce(late, F.lit(False)), F.col("owner_session_id")).otherwise(stem))
    )


def messages_of(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per (file, session, uuid), the last one in the file."""
    rows = _owned(records, sessions).select(
        "session_id", "uuid", "parent_uuid", "type", "timestamp", "is_sidechain", "role", "model", "stop_reason",
        *USAGE, "content_types", "tool_name", "tool_input_summary", "text_content",
        "file_path", "mtime_ms", "owner_session_id", "pos",
    )
    return last_per_key(rows, ["file_path", "session_id", "uuid"], ["file_path"])


def tool_calls_of(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per tool_use block; of a replayed (session, message, idx) the last one."""
    used = records.where(F.size("tool_uses") > 0)
    rows = _owned(used, sessions).select(
        "session_id", F.col("uuid").alias("message_uuid"), "timestamp",
        "file_path", "mtime_ms", "owner_session_id", "pos", F.explode("tool_uses").alias("t"),
    ).select(
        "session_id", "message_uuid", F.col("t.name").alias("tool_name"), F.col("t.input").alias("tool_input"),
        "timestamp", F.col("t.idx").cast("int").alias("idx"), "file_path", "mtime_ms", "owner_session_id", "pos",
    )
    return last_per_key(rows, ["file_path", "session_id", "message_uuid", "idx"], ["file_path", "idx"])

"""Source files derived from the given tables, as the scans would hand them over.

Each conversation is a transcript, each event a line of a hook log, each
document an index, a todo list, a debug log and a note. Odd lines, replays and
spoiled files are mixed in by rule, so that every ingest rule has work to do on
every part of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.derived import table

EPOCH_MS = 1704067200000  # 2024-01-01T00:00:00Z
TOOLS = ("Read", "Edit", "Bash")
LOG_OF_EVENT = {
    "signup": "sessionstart", "purchase": "posttooluse", "view": "pretooluse", "click": "notification", "error": "ensure-stop",
}


def _s(c: Column) -> Column:
    return c.cast("string")


def _json_string(c: Column) -> Column:
    """Text as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def _minutes_after(n: Column) -> Column:
    return F.timestamp_add("MINUTE", n, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))


def transcript_lines(spark: SparkSession, sf: str, up_to_turn: int | None = None) -> DataFrame:
    """Transcript files, as they are now or as they were when they ended at a turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf, "conversations")
    if up_to_turn is not None:
        rows = rows.where(turn <= up_to_turn)
    folder = F.concat(F.lit("/src/projects/proj-"), _s(conv % 12))
    path = F.when(
        conv % 5 == 4, F.concat(folder, F.lit("/c"), _s(conv - 1), F.lit("/subagents/agent-"), _s(conv), F.lit(".jsonl"))
    ).otherwise(F.concat(folder, F.lit("/f"), _s(conv), F.lit(".jsonl")))
    own = F.when((conv % 3 == 0) & (turn == 0), F.lit(None)).otherwise(
        F.concat(F.lit("c"), _s(F.when(conv % 5 == 3, conv - 1).otherwise(conv)))
    )
    stamp = F.when(turn % 6 == 5, F.lit("not a time")).otherwise(
        F.date_format(_minutes_after(conv * 37 + turn), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    odd = turn % 2 == 1
    tool = F.when(turn % 3 == 0, TOOLS[0]).when(turn % 3 == 1, TOOLS[1]).otherwise(TOOLS[2])

    def record(text: Column, factor: int) -> Column:
        blocks = F.concat(
            F.lit('["bare",'),
            F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))),
            F.lit(","),
            F.to_json(
                F.struct(
                    F.lit("tool_use").alias("type"),
                    F.when(turn % 4 == 3, "").otherwise(tool).alias("name"),
                    F.struct(text.alias("t"), turn.alias("n")).alias("input"),
                )
            ),
            F.lit(","),
            F.to_json(
                F.struct(F.lit("tool_use").alias("type"), F.when(turn % 4 == 3, "Glob").otherwise("").alias("name"))
            ),
            F.lit("]"),
        )
        head = F.to_json(
            F.struct(
                F.col("role").alias("role"),
                F.when(odd, F.concat(F.lit("model-"), _s(turn % 3))).alias("model"),
                F.when(odd, "end_turn").alias("stop_reason"),
                F.struct(
                    (F.length("text") * factor).alias("input_tokens"),
                    turn.alias("output_tokens"),
                    (conv % 100).alias("cache_read_input_tokens"),
                ).alias("usage"),
            )
        )
        message = F.concat(
            F.regexp_replace(head, r"\}$", ""),
            F.lit(',"content":'),
            F.when(odd, blocks).otherwise(_json_string(text)),
            F.lit("}"),
        )
        top = F.to_json(
            F.struct(
                F.col("role").alias("type"),
                F.concat(F.lit("c"), _s(conv), F.lit("-"), _s(turn)).alias("uuid"),
                F.when(turn > 0, F.concat(F.lit("c"), _s(conv), F.lit("-"), _s(turn - 1))).alias("parentUuid"),
                own.alias("sessionId"),
                F.concat(F.lit("/w/"), _s(conv)).alias("cwd"),
                F.concat(F.lit("1."), _s(turn)).alias("version"),
                F.when(odd, F.concat(F.lit("b"), _s(turn))).alias("gitBranch"),
                stamp.alias("timestamp"),
                F.when(turn % 7 == 6, True).alias("isSidechain"),
            )
        )
        spoiled = (conv % 17 == 16) & (turn == 1)
        return F.concat(
            F.regexp_replace(top, r"\}$", ""),
            F.lit(',"message":'),
            F.when(spoiled, "null").otherwise(message),
            F.lit("}"),
        )

    first = record(F.col("text"), 1)

    def line(block: Column, value: Column) -> Column:
        return F.struct(block.cast("bigint").alias("block_start"), value.alias("value"))

    lines = F.array_compact(
        F.array(
            line(F.floor(turn / 4) * 100, first),
            F.when(turn % 4 == 2, line(F.lit(500), F.lit('{"type":"file-history-snapshot","uuid":"x","message":null}'))),
            F.when(turn % 4 == 3, line(F.lit(600), F.concat(first, F.lit(" trailing")))),
            F.when(turn % 3 == 1, line(F.lit(1000), record(F.lit("again"), 2))),
        )
    )
    return rows.select(
        path.alias("file_path"),
        (F.lit(EPOCH_MS) + conv * 1000).alias("mtime_ms"),
        F.length("text").cast("bigint").alias("file_size"),
        turn.alias("line_id"),
        F.explode(lines).alias("l"),
    ).select("file_path", "mtime_ms", "file_size", "l.block_start", "line_id", "l.value")


def transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    """The listing that goes with the transcripts."""
    return transcript_lines(spark, sf).groupBy("file_path", "mtime_ms").agg(F.sum("file_size").alias("file_size"))


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per source, holding its documents one after the other."""
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/src/"), F.col("source"), F.lit(".txt")).alias("file_path"),
        F.floor(doc / 1000).alias("block_start"),
        doc.alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("i", "value"),
    ).withColumn("line_id", F.col("doc_id") * 1_000_000 + F.col("i"))


def hook_lines(spark: SparkSession, sf: str) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    stem = F.lit(None).cast("string")
    for name, log in LOG_OF_EVENT.items():
        stem = F.when(kind == name, log).otherwise(stem)
    stamp = F.when(event % 13 == 0, "2024-02-30 10:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    fields = (
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("session_id"),
        F.lit("/w").alias("cwd"),
        kind.alias("tool_name"),
    )
    full = F.to_json(
        F.struct(
            *fields,
            F.struct(
                kind.alias("t"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k")
            ).alias("tool_input"),
        )
    )
    bare = F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", ',"tool_input":{}}')
    payload = (
        F.when(event % 5 == 0, "plain text").when(event % 5 == 1, "[1]").when(event % 5 == 2, bare).otherwise(full)
    )
    value = F.when(event % 11 == 0, payload).otherwise(F.concat(stamp, F.lit(" "), payload, F.lit(" \r")))
    return table(spark, sf, "events").select(
        F.concat(F.lit("/src/logs/"), stem, F.lit(".log")).alias("file_path"),
        F.lit(EPOCH_MS).alias("mtime_ms"),
        F.lit(0).cast("bigint").alias("file_size"),
        F.floor(event / 1000).alias("block_start"),
        event.alias("line_id"),
        value.alias("value"),
        "user_id",
    )


def index_file() -> list[Column]:
    """A session index per document, an entry per line; documents come in pairs with the same session ids."""
    doc = F.col("doc_id")

    def entry(line: Column, i: Column) -> Column:
        name = F.concat(F.lit("d"), _s(doc - doc % 2), F.lit("-"), _s(i))
        return F.struct(
            name.alias("sessionId"),
            F.when(i % 4 != 0, F.concat(F.lit("/src/t/"), name, F.lit(".jsonl"))).alias("fullPath"),
            F.col("lang").alias("gitBranch"),
            F.lit("2024-01-02T03:04:05.000Z").alias("created"),
            F.when(i % 3 != 0, i).alias("messageCount"),
            line.alias("firstPrompt"),
            line.alias("summary"),
        )

    index = F.struct(
        F.concat(F.lit("/orig/"), F.col("source")).alias("originalPath"),
        F.transform(F.split("text", "\n"), entry).alias("entries"),
    )
    return [
        F.concat(F.lit("/src/projects/"), F.col("source"), F.lit("/"), _s(doc), F.lit("/sessions-index.json")).alias("file_path"),
        (F.lit(EPOCH_MS) + doc * 1000).alias("mtime_ms"),
        F.to_json(index).alias("value"),
    ]


def index_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(*index_file())


def index_present(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts that still exist: every other entry of the indexes."""
    doc = F.col("doc_id")
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("i") % 2 == 1).select(
        F.concat(F.lit("/src/t/d"), _s(doc - doc % 2), F.lit("-"), _s(F.col("i")), F.lit(".jsonl")).alias("file_path")
    )


def todo_file(emptied: bool = False) -> list[Column]:
    """A todo list per document; in the later version every third list was emptied, every fifth broken."""
    doc = F.col("doc_id")
    items = F.to_json(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct(
                line.alias("content"), F.when(i % 2 == 0, "done").alias("status"), F.col("lang").alias("activeForm")
            ),
        )
    )
    value = F.when(doc % 3 == 0, "[]").when(doc % 5 == 0, "{}").otherwise(items) if emptied else items
    name = F.concat(F.lit("/src/todos/d"), _s(doc), F.when(doc % 2 == 0, "-agent-x.json").otherwise(".json"))
    return [name.alias("file_path"), F.lit(EPOCH_MS + int(emptied)).alias("mtime_ms"), value.alias("value")]


def todo_files(spark: SparkSession, sf: str, emptied: bool = False) -> DataFrame:
    return table(spark, sf, "documents").select(*todo_file(emptied))


def debug_lines(spark: SparkSession, sf: str, grown: bool = True) -> DataFrame:
    """A debug log per document: its first line at first, later all lines under another first line. Every ninth is empty."""
    doc, first = F.col("doc_id"), F.col("line_id") == 0
    stamp = F.when((doc % 2 == 0) & first, "2024-01-02T03:04:05.5Z  ").otherwise("")
    lines = table(spark, sf, "documents").where(doc % 9 != 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_id", "line"))
    lines = lines.withColumn("line", F.when(first, "changed").otherwise(F.col("line"))) if grown else lines.where(first)
    return lines.select(
        F.concat(F.lit("/src/debug/d"), _s(doc), F.lit(".txt")).alias("file_path"),
        F.lit(0).alias("block_start"),
        "line_id",
        F.concat(stamp, F.col("line")).alias("value"),
    )


def debug_files(spark: SparkSession, sf: str, grown: bool = True) -> DataFrame:
    doc = F.col("doc_id")
    size = F.octet_length("text" if grown else F.substring_index("text", "\n", 1))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/src/debug/d"), _s(doc), F.lit(".txt")).alias("file_path"),
        F.lit(EPOCH_MS + int(grown)).alias("mtime_ms"),
        F.when(doc % 9 != 0, size).otherwise(0).cast("bigint").alias("file_size"),
    )


def note_file(grown: bool = False) -> list[Column]:
    """A note per document, half of them with a telling name, half with a header."""
    doc = F.col("doc_id")
    name = F.when(
        doc % 2 == 0,
        F.concat(F.lit("20240102T03"), F.lpad(_s(doc % 60), 2, "0"), F.lit("05_note_"), F.col("lang"), F.lit("_on-"), _s(doc), F.lit("-x.md")),
    ).otherwise(F.concat(F.lit("free-"), _s(doc), F.lit(".md")))
    head = F.when(doc % 2 == 1, F.concat(F.lit("agent: "), F.col("lang"), F.lit("\ntimestamp: 2024-01-02T03:04:05Z\n"))).otherwise("")
    text = F.concat(head, F.lit("grown\n") if grown else F.lit(""), F.col("text"))
    return [
        F.concat(F.lit("/src/history/"), F.when(doc % 7 != 0, F.concat(F.col("source"), F.lit("/"))).otherwise(""), name).alias("file_path"),
        F.lit(EPOCH_MS + int(grown)).alias("mtime_ms"),
        text.alias("value"),
    ]


def note_files(spark: SparkSession, sf: str, grown: bool = False) -> DataFrame:
    return table(spark, sf, "documents").select(*note_file(grown))

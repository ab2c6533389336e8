"""Tables of the data model derived from the given tables.

The given data has no transcripts, so events stand in for messages and tool
calls, their sessions for sessions, documents for notes and side files, and
conversations for searchable text. Everything is derived by Spark from whole
tables and grows with them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


AS_OF = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One message, which is also one tool call, per event."""
    user, event = F.col("user_id"), F.col("event_id")
    span = (
        F.when(user % 3 == 0, F.to_date("ts").cast("string"))
        .when(user % 3 == 1, F.to_date(F.date_trunc("week", "ts")).cast("string"))
        .otherwise("all")
    )
    tokens_in = F.floor(F.col("value") * 100)
    cached = F.col("event_type").isin("view", "click")
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), user.cast("string"), F.lit("-"), span).alias("session_id"),
        F.concat(F.lit("e"), event.cast("string")).alias("uuid"),
        F.concat(F.lit("proj-"), (user % 12).cast("string")).alias("project_name"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("tool_name"),
        "event_id",
        F.when(event % 3 == 0, "model-sonnet-1").when(event % 3 == 1, "model-opus-1").otherwise("model-haiku-1").alias("model"),
        tokens_in.alias("input_tokens"),
        F.floor(F.col("value") * 10).alias("output_tokens"),
        F.when(cached, tokens_in * 3).otherwise(F.lit(0).cast("bigint")).alias("cache_read_tokens"),
        F.when(cached, F.lit(0).cast("bigint")).otherwise(tokens_in).alias("cache_write_tokens"),
    )


def event_sessions(spark: SparkSession, sf: str, prompts: bool = False, events: DataFrame | None = None) -> DataFrame:
    """One session per group of events (all, or some of them); first prompts come from all documents in turn."""
    sessions = (
        (event_messages(spark, sf) if events is None else events)
        .groupBy("session_id", "project_name")
        .agg(
            F.min("timestamp").alias("created_at"),
            F.max("timestamp").alias("modified_at"),
            F.count("*").alias("message_count"),
            F.sum("input_tokens").alias("total_input_tokens"),
            F.sum("output_tokens").alias("total_output_tokens"),
            F.sum("cache_read_tokens").alias("total_cache_read"),
            F.sum("cache_write_tokens").alias("total_cache_write"),
            F.min("event_id").alias("first_event"),
        )
    )
    if not prompts:
        return sessions.drop("first_event")
    documents = table(spark, sf, "documents")
    count = documents.agg(F.count("*")).scalar()
    texts = documents.select("doc_id", F.col("text").alias("doc_text"))
    return (
        sessions.join(texts, F.col("first_event") % count == F.col("doc_id"), "left")
        .withColumn("first_prompt", F.when(F.col("first_event") % 11 != 0, F.col("doc_text")))
        .drop("first_event", "doc_id", "doc_text")
    )


def event_hooks(spark: SparkSession, sf: str) -> DataFrame:
    return event_messages(spark, sf).select(
        F.col("event_id").alias("id"), F.col("tool_name").alias("event_type"), "session_id", "timestamp"
    )



def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), conv).alias("session_id"),
        F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string")).alias("uuid"),
        F.col("role").alias("type"),
        F.timestamp_add("MINUTE", F.col("conv_id") * 37 + F.col("turn"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("timestamp"),
        F.col("text").alias("text_content"),
        "conv_id",
    )


def conversation_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        conversation_messages(spark, sf)
        .groupBy("session_id", "conv_id")
        .agg(
            F.min("timestamp").alias("created_at"),
            F.count("*").alias("message_count"),
            F.min_by("text_content", "timestamp").alias("first_prompt"),
        )
        .withColumn("project_name", F.concat(F.lit("proj_"), (F.col("conv_id") % 12).cast("string")))
    )


def document_history(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/history/"), F.col("source"), F.lit("/"), doc.cast("string"), F.lit(".md")).alias("file_path"),
        F.col("source").alias("category"),
        F.col("lang").alias("agent"),
        F.timestamp_add("MINUTE", doc, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("timestamp"),
        F.concat(F.lit("note on "), F.col("source"), F.lit(" in "), F.col("lang")).alias("description"),
        F.col("text").alias("content"),
    )

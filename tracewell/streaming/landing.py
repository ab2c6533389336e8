"""Continuous ingest from a landing zone of finished transcript files.

The file source reads each file once and does not come back when one grows, so
this suits folders that receive whole files. Transcripts that are still being
written belong to ``sync``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.plans.sync import load_transcripts
from tracewell.plans.warehouse import SourceState, Warehouse
from tracewell.session import configure
from tracewell.sources import files

SOURCE = "landing"


def transcript_stream(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.jsonl",
    max_files: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Lines of arriving files; ``archive`` moves files there once they are read."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(folder).select(*files.line_source(), "value")


def load_batch(lines: DataFrame, stream_batch: int, out: str, on_error: str = "file") -> None:
    """Load one micro-batch as one batch of the tables; a batch that was committed before is left alone."""
    spark = lines.sparkSession
    wh = Warehouse(spark, out)
    old = wh.state.get(SOURCE, SourceState())
    if stream_batch < old.last_offset:
        return
    numbered = lines.withColumn("line_id", F.monotonically_increasing_id())
    loaded, rejects = load_transcripts(wh, numbered, on_error)
    wh.write("_rejects", rejects)
    done = loaded.agg(F.count("*").alias("n"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("rows")).first()
    now = dt.datetime.now(dt.timezone.utc)
    wh.commit({**wh.state, SOURCE: old.advanced(done.n, done.rows, now, offset=stream_batch + 1)})


def start_landing(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    on_error: str = "file",
    available_now: bool = True,
    interval: str = "10 minutes",
    **source,
) -> StreamingQuery:
    """Feed the tables from the landing zone, once over what is there or at an interval."""
    stream = transcript_stream(configure(spark), folder, **source)
    writer = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda lines, batch: load_batch(lines, batch, out, on_error))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()

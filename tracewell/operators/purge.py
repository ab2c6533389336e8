"""Which transcripts could be removed because the tables already hold them. Nothing is deleted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.constants import PURGE_AGE_DAYS


def classify_files(
    listing: DataFrame, sessions: DataFrame, as_of: dt.datetime, age_days: int = PURGE_AGE_DAYS
) -> DataFrame:
    """Files as ``recent``, ``unsynced`` or ``purgeable``; a time without zone is UTC."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    cutoff_ms = int((as_of - dt.timedelta(days=age_days)).timestamp() * 1000)
    synced = sessions.select("file_path").distinct().withColumn("synced", F.lit(True))
    return listing.join(synced, "file_path", "left").withColumn(
        "class",
        F.when(F.col("mtime_ms") > cutoff_ms, "recent")
        .when(F.col("synced").isNull(), "unsynced")
        .otherwise("purgeable"),
    )


def purge_candidates(
    listing: DataFrame, sessions: DataFrame, as_of: dt.datetime, age_days: int = PURGE_AGE_DAYS
) -> DataFrame:
    """Number and bytes of files per class."""
    return (
        classify_files(listing, sessions, as_of, age_days)
        .groupBy("class")
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    )

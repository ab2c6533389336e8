"""Timestamps from text; anything unreadable is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
)
# Two spellings the cast does not know: a time without seconds but with a zone, and a decimal comma.
NO_SECONDS = r"^(.{10}[T ]\d{2}:\d{2})([Zz]|[+-].*)?$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 date or time, UTC where no offset is given."""
    rewritten = F.regexp_replace(F.regexp_replace(text, NO_SECONDS, "$1:00$2"), ",", ".")
    read = F.coalesce(text.try_cast("timestamp"), rewritten.try_cast("timestamp"))
    return F.when(text.rlike(ISO), read)


def parse_format(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))

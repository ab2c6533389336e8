"""Paths of source files, and where lines of Spark's text source come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.sources.listing import list_tree

META = "_metadata"


def plain_path(uri: Column) -> Column:
    """The path as written by the user: percent-decoded, without the scheme of local files."""
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name_of(path), r"(?s)(.)\.[^.]*$", "$1")


def ancestor(path: Column, up: int) -> Column:
    """Name of the directory ``up`` levels above the file."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-1 - up)), F.lit(""))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def is_subagent(path: Column) -> Column:
    return F.contains(path, F.lit("/subagents/"))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    columns = StructType.fromDDL(ddl).fields
    return spark.range(0).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in columns))


def or_empty(load: Callable[[], DataFrame], spark: SparkSession, ddl: str) -> DataFrame:
    """A folder that does not exist yet is an empty source."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, ddl)
        raise


def _meta(field: str) -> Column:
    return F.col(f"{META}.{field}")


def line_source() -> list[Column]:
    """Where a line comes from, except its place within the split."""
    return [
        plain_path(_meta("file_path")).alias("file_path"),
        F.unix_millis(_meta("file_modification_time")).alias("mtime_ms"),
        _meta("file_size").alias("file_size"),
        _meta("file_block_start").alias("block_start"),
    ]


def list_newer(spark: SparkSession, root: str, suffix: str, after_ms: int, recurse: bool = False) -> DataFrame:
    """Files changed after the watermark, oldest first."""
    found = list_tree(spark, [(root, recurse)]).drop("root")
    return found.where(F.endswith("file_path", F.lit(suffix)) & (F.col("mtime_ms") > after_ms)).orderBy("mtime_ms", "file_path")

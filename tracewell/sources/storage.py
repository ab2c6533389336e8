"""Opening files and folders from Python, on the driver or in a task, by the same paths that Spark takes."""

from __future__ import annotations

from urllib.parse import unquote

from pyarrow import fs

#: Schemes of Spark's connectors, and what the file systems of pyarrow call them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, the path in it, what goes before such a path to make it one for Spark).

    A path without a scheme is one of the local file system. Raises ValueError for schemes that only Spark reads.
    """
    scheme, mark, rest = path.partition(":/")
    if not mark or "/" in scheme or not scheme:
        return fs.LocalFileSystem(), path, ""
    if scheme not in SCHEMES:
        raise ValueError(f"{path}: files are opened under {', '.join(sorted(SCHEMES))} or a local path")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/"), ""
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:/{rest}")
    host = rest.lstrip("/").partition("/")[0]
    # buckets are part of the inner path, the name nodes of HDFS are not
    return system, inner, f"{scheme}://{host}" if SCHEMES[scheme] == "hdfs" else f"{scheme}://"

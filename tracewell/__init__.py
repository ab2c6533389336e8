"""Transcript analytics on Spark: ingest session transcripts, then report on them."""

from tracewell.session import build_session, configure

__all__ = ["build_session", "configure"]

"""Structured Streaming entry: answer query files as they arrive (micro-batches)."""

from tomescope.streaming.serve import QUERY_SCHEMA, serve_queries  # noqa: F401

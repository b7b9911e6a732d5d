"""Structured Streaming entry points (stateless scoring of new rows)."""

from tabflow.streaming.scoring import score_stream  # noqa: F401

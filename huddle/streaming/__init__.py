"""Structured Streaming: incremental ingest and per-part wide rows."""

from huddle.streaming.ingest import (  # noqa: F401
    read_parts_stream, stream_event_rows, stream_merge, stream_wide_features,
)

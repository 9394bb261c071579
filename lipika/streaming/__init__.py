"""Incremental ingest of streams of documents."""

from .ingest import latest, stream_chunks

__all__ = ["latest", "stream_chunks"]

"""Incremental runs over trial files as they land."""

from eligo.streaming.criteria import stream_criteria

__all__ = ["stream_criteria"]

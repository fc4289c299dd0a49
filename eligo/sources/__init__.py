"""Readers and writers."""

from eligo.sources.tables import table

__all__ = ["table"]

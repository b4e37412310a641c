"""Readers of landed tables and raw HTML."""

from waraq.sources.tables import table

__all__ = ["table"]

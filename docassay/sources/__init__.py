"""Readers and writers of tables, audit logs and images."""

from docassay.sources.tables import read_table, spread, stream_table

__all__ = ["read_table", "spread", "stream_table"]

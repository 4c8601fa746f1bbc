"""Readers: stored tables, the bound test views, landed JSON / CSV payloads."""

from cadence.sources.tables import TABLE_NAMES, Tables, read_tables, write_tables

__all__ = ["TABLE_NAMES", "Tables", "read_tables", "write_tables"]

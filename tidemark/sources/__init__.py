"""Readers for tables, change logs and recorded messages."""

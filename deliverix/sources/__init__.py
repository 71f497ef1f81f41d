"""Readers, table builders and writers."""

"""Readers and writers: delimited participant logs, CSV tables, summaries."""

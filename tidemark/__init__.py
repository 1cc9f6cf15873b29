"""Tidemark: append-only, schema-aware topic logs as Spark tables.

Rows are appended to ``topic/partition`` and get a sequential index; segments
are Parquet files described by a manifest. Scans are ordered, limited and
resumable, and every topic is also an ordinary DataFrame.
"""

"""Readers and writers: files (CSV / Parquet / JSON lines), JDBC, report sinks."""

from tabflow.sources.files import read_table  # noqa: F401

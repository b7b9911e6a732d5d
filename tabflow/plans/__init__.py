"""Registered queries: each is a Spark plan over the given tables plus, where
SQL can express it, an independent DuckDB oracle."""

from tabflow.plans.registry import QUERIES, ORACLE_SQL  # noqa: F401

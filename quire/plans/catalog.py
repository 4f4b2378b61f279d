"""Registry of the named queries: Spark builder plus DuckDB oracle text.

Every entry reads the fixture views over the driver's whole tables. The
oracle is an independent SQL formulation run by DuckDB on the same Parquet
files; column names and types are aligned (bigint for counts and ranks,
doubles rounded to 6 places, timestamps as strings).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from quire.plans import q_ann, q_more, q_search, q_stream, q_tables, q_text  # noqa: F401

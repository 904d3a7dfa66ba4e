"""Every query of the core by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.operators import episodes, feedback, fulltext, incremental, lookups, memories, metrics, orphans, sessions, summaries, tables, vectors
from tidepool.plans import coverage, search
from tidepool.streaming import streams

_MODULES = [orphans, sessions, incremental, episodes, memories, fulltext, lookups, summaries, tables, vectors, feedback, search, metrics, streams, coverage]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)

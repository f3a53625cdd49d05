"""All queries over the reference's own operators, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans import annotate, dedup, dialogue, speech

_PARTS = (dialogue, dedup, annotate, speech)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _PARTS for k, f in m.Q.items()}
ORACLES: dict[str, str] = {k: s for m in _PARTS for k, s in m.SQL.items()}

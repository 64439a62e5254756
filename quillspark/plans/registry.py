"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evidence, extras, search, stores, studio

FLAGSHIP = "hybrid_search"
_PARTS = (search, corpus, evidence, extras, stores, studio)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}

"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspan.plans import entity_queries, job_queries, press_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**press_queries.QUERIES, **entity_queries.QUERIES, **job_queries.QUERIES}
ORACLES: dict[str, str] = {**press_queries.ORACLES, **entity_queries.ORACLES, **job_queries.ORACLES}
FLAGSHIP = entity_queries.canonical_counts

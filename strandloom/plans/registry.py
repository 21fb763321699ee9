"""Queries of the interval, sequence, probe and read operators over the driver's tables, each with its
SQL. All run over whole tables; domain inputs (genomes, regions, reads) are derived from them by the
same expressions on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import design_queries, format_queries, interval_queries, read_queries, sequence_queries

_PARTS = (interval_queries, sequence_queries, design_queries, read_queries, format_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}

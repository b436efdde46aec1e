"""Queries on the given tables, one or more per operator."""

from signalloom.catalog import (  # noqa: F401
    event_queries,
    explain_queries,
    metric_queries,
    plan_queries,
    quality_queries,
    signal_queries,
    source_queries,
    split_queries,
    stream_queries,
    summary_queries,
)
from signalloom.catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries of the panel operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelyard.plans import builder_queries, decision_queries, fitting_queries, model_queries, panel_queries, play_queries, record_queries, report_queries, stream_queries  # noqa: F401  they register themselves
from panelyard.plans.registry import QUERIES, SQL

FLAGSHIP = "flagship"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

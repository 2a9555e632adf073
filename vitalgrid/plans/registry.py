"""All queries and their SQL counterparts by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.plans import (
    graph_oracles,
    graph_queries,
    model_oracles,
    model_queries,
    survey_oracles,
    survey_queries,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**survey_queries.QUERIES, **model_queries.QUERIES, **graph_queries.QUERIES}


def oracles() -> dict[str, str]:
    return {**survey_oracles.ORACLES, **model_oracles.ORACLES, **graph_oracles.ORACLES}

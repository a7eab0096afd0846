"""Every query of the library outside ``llm``, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import catalog_plans, diff_plans, entity_plans, evaluate_plans, pair_plans, state_plans, store_plans, vector_plans
from corvane.streaming import changefeed

MODULES = [vector_plans, pair_plans, diff_plans, store_plans, state_plans, entity_plans, catalog_plans, evaluate_plans, changefeed]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}

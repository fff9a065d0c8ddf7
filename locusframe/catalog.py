"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "load_points"
MODULES = ("locusframe.plans.geometry_and_graphs", "locusframe.plans.rules_and_texts", "locusframe.plans.shapes_and_summaries", "locusframe.plans.space", "locusframe.plans.time_and_circle", "locusframe.plans.results", "locusframe.plans.contours_and_decisions", "locusframe.plans.trees_and_fits", "locusframe.plans.cells_and_tours")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(m).ORACLES.items()}

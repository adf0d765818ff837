"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import fixture, problems, star, tables, upkeep
from loomgraph.streaming import watch


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**star.QUERIES, **tables.QUERIES, **upkeep.QUERIES, **fixture.QUERIES, **watch.QUERIES, **problems.QUERIES}

"""SQL for DuckDB with the results of the core queries."""

from __future__ import annotations

from loomgraph.plans import fixture, oracle_problems, oracle_tables, star, upkeep
from loomgraph.streaming import watch


def oracle_sql() -> dict[str, str]:
    return {**star.ORACLES, **oracle_tables.ORACLES, **upkeep.ORACLES, **fixture.ORACLES, **watch.ORACLES, **oracle_problems.ORACLES}

"""All registered reference queries."""

from __future__ import annotations

from encore.plans.registry import Query, Registry

from encore.plans import aggregates, entities, filters, incremental, joins, repairs, scalars, scans, windows  # noqa: E402

ALL: list[Registry] = [scans.reg, filters.reg, joins.reg, aggregates.reg, windows.reg, entities.reg, repairs.reg, scalars.reg, incremental.reg]


def queries() -> dict[str, Query]:
    return {k: q for r in ALL for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in ALL for k, s in r.oracles.items()}

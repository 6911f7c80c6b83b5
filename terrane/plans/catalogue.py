"""All queries of the engine: name -> query, and name -> SQL."""

from __future__ import annotations

from terrane.plans import landscapes, matrices, relations, series  # noqa: F401  (they register their queries)
from terrane.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

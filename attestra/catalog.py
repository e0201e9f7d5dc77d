"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from .plans import advisory, alerts, details, evidence, extracts, geography, history, intake, places, relational, scalars, series, streams, verification  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL, Plan


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Where plans register themselves as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name, with the SQL of the same rows if there is any."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return add

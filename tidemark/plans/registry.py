"""The registered queries: a Spark plan and, where SQL can say it, the same thing in SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a ``(spark, folder) -> DataFrame`` under its own name."""

    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan

    return add

"""Where queries and their DuckDB text are registered, and what their texts share."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def metres(c) -> F.Column:
    """Tenths of a metre, half up."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10 + 0.5).cast("long")


def tenths(sql: str) -> str:
    return f"cast(floor({sql} * 10 + 0.5) as bigint)"


H = V.haversine_sql
KEY = V.key_sql
NOW = "2024-01-20 00:00:00"
NEAR = "a.latitude between b.latitude - 0.01 and b.latitude + 0.01 and a.longitude between b.longitude - 0.01 and b.longitude + 0.01"

"""All queries of the analytics part, with their SQL."""

from __future__ import annotations

from functools import partial

from . import frame_queries, model_queries
from .sql_queries import SQL
from .views import run_sql, with_views


def queries() -> dict:
    found = {name: partial(run_sql, sql=sql) for name, sql in SQL.items()}
    return found | frame_queries.QUERIES | model_queries.QUERIES | model_queries.DRAWN_QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()} | frame_queries.oracle() | model_queries.ORACLE

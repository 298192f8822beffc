"""Queries of the graph operators and their SQL."""

from graphloom.plans.queries import QUERIES
from graphloom.plans.sql import SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from functools import wraps

from ..ship import ship


def shipped(f):
    """The query, with the package sent to the executors first."""
    @wraps(f)
    def run(spark, sf):
        ship(spark)
        return f(spark, sf)
    return run


def registry():
    """All queries and their SQL, by name."""
    from . import learning, ranking, relational
    queries, sql = {}, {}
    for module in (relational, ranking, learning):
        queries.update({name: shipped(f) for name, f in module.QUERIES.items()})
        sql.update(module.SQL)
    return queries, sql

"""Registered queries: each runs an operator over a workspace's tables."""

from ..sources.tables import workspace

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function of a workspace, with the SQL text that gives the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add

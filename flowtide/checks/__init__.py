"""Queries over the driver's tables with their SQL oracles."""

from flowtide.checks.registry import ORACLES, QUERIES


def _load():
    from flowtide.checks import analytics_queries, flow_queries, model_queries, policy_queries, store_queries, stream_queries  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)

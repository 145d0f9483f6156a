"""Collects the registered queries of every query module."""

from __future__ import annotations

from tabprep.plans import q_clean, q_features, q_profile  # noqa: F401  they register their queries
from tabprep.plans.catalog import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)

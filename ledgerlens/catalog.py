"""Collects the registered queries of every plan module."""

from __future__ import annotations

from ledgerlens.plans import embedding_queries, export_queries, feature_queries, model_queries, prep_queries  # noqa: F401
from ledgerlens.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

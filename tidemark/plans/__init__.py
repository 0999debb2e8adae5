"""Queries bound to the given tables."""

from __future__ import annotations

import importlib

MODULES = ["indicator_queries", "align_queries", "clean_queries", "signal_queries", "metric_queries", "ledger_queries", "sweep_queries", "source_queries", "event_queries"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


def flagship(spark, sf):
    from tidemark.plans.metric_queries import trend_against_hold

    return trend_against_hold(spark, sf)

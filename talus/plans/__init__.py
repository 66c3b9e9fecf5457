"""Registered queries over the shared test tables."""

from __future__ import annotations

import importlib

MODULES = ("cohort_queries", "feature_queries", "skew_queries", "telemetry_queries", "model_queries", "scalar_queries", "source_queries")


def load_all():
    """Import every query module; returns (queries, oracles)."""
    from talus.plans import registry

    for name in MODULES:
        importlib.import_module(f"talus.plans.{name}")
    return registry.QUERIES, registry.ORACLES

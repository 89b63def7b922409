"""Queries over the driver tables, one per operator, each with the SQL it must equal."""

from __future__ import annotations

import importlib

MODULES = (
    "sources_and_projections",
    "joins_and_sets",
    "groups_and_profiles",
    "labels",
    "evaluation",
    "sql_surface",
    "observed",
    "workflows",
    "maps_and_changes",
)


def all_queries() -> tuple[dict, dict]:
    """Every registered query and every SQL statement, by name."""
    from workload.base import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"workload.{module}")
    return QUERIES, ORACLES

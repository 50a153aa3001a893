"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = [
    "text_queries", "row_queries", "link_queries", "spatial_queries", "plan_queries", "source_queries",
    "model_queries",
]


def load():
    from hostelry.registry.core import QUERIES

    for module in MODULES:
        importlib.import_module(f"hostelry.registry.{module}")
    return QUERIES

"""Registered queries and their SQL twins, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ["reading", "rating", "preparing", "forecasting", "deciding", "operating", "streams"]


def load() -> dict:
    """Import every area and return the registries."""
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    base = importlib.import_module(f"{__name__}.base")
    return {"QUERIES": base.QUERIES, "SQL": base.SQL, "COVERS": base.COVERS}

"""Registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

from clinframe.queries.registry import ORACLES, QUERIES

for _module in ("cohort", "scores", "retrieval", "text", "models"):
    importlib.import_module(f"clinframe.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]

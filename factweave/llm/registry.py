"""The queries of this package with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["queries", "vector_queries"]


def queries() -> dict:
    return {n: f for m in MODULES for n, f in importlib.import_module(f"factweave.llm.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in importlib.import_module(f"factweave.llm.{m}").ORACLES.items()}

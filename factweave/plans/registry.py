"""All registered queries with their SQL twins, collected from the area modules."""

from __future__ import annotations

import importlib

AREAS = ["facts", "questions", "filings", "graph", "prices", "runs", "text", "tables", "certify", "streams"]


def _modules():
    for area in AREAS:
        try:
            yield importlib.import_module(f"factweave.plans.{area}")
        except ModuleNotFoundError as exc:
            if exc.name != f"factweave.plans.{area}":
                raise


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}

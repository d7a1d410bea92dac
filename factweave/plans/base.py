"""Registration of queries with their SQL twins."""

from __future__ import annotations


class Area:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn
        return add

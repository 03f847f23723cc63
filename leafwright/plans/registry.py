"""Queries of a module by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def add(fn: Callable) -> Callable:
            self._queries[name] = fn
            if sql is not None:
                self._sql[name] = sql
            return fn

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)

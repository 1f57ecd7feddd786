"""One declaration per query: name, operator ids, Spark callable and oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    fn: QueryFn
    sql: str | None


class Registry:
    """Collects queries; names are unique."""

    def __init__(self) -> None:
        self._by_name: dict[str, Query] = {}

    def query(self, name: str, ops: str = "", sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def add(fn: QueryFn) -> QueryFn:
            if name in self._by_name:
                raise ValueError(f"query {name} is declared twice")
            self._by_name[name] = Query(name, tuple(ops.split()), fn, sql)
            return fn

        return add

    def callables(self) -> dict[str, QueryFn]:
        return {k: q.fn for k, q in self._by_name.items()}

    def oracles(self) -> dict[str, str]:
        return {k: q.sql for k, q in self._by_name.items() if q.sql is not None}

    def operators(self) -> dict[str, tuple[str, ...]]:
        return {k: q.ops for k, q in self._by_name.items()}


REGISTRY = Registry()

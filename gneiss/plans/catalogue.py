"""The named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


_entries: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name that nobody else uses."""

    def put(run: Query) -> Query:
        if name in _entries:
            raise ValueError(f"query {name!r} is registered twice")
        _entries[name] = Entry(name, run, sql)
        return run

    return put


def _load() -> None:
    from gneiss.plans import library  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return {n: e.run for n, e in _entries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: e.sql for n, e in _entries.items() if e.sql}

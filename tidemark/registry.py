"""Name -> query and name -> oracle SQL, filled by the modules in tidemark.plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: files a (spark, sf_dir) callable under name, with its oracle if SQL has one."""

    def file(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return file


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same rows."""
    return _ORACLES[name]


def queries() -> dict[str, Query]:
    from tidemark import plans  # noqa: F401  fills the tables

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    from tidemark import plans  # noqa: F401

    return _ORACLES

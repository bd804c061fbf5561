"""Named queries over the test tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cuebase.plans.bindings import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries.
_MODULES = ["listing", "programs", "spectra", "signals", "layouts", "checks", "ports"]


def query(name: str, oracle: str | None = None):
    """Register f(views) -> DataFrame under a name."""
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if oracle:
            _ORACLES[name] = with_views(oracle)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"cuebase.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES

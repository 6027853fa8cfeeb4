"""Every query by name with its SQL counterpart; modules of this package add theirs by the query decorator."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["grading", "cleaning", "pairing", "evaluation", "training", "sources", "streams"]


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"rollforge.plans.{module}")

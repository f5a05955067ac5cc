"""All registered queries of the reference's operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that register queries.
MODULES = ("sequences", "joining", "measures", "structures", "more", "records")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the equivalent SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Imports all modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__package__}.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["episodes"](spark, sf_dir)

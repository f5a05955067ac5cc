"""Named measures: an aggregate of a path's rows under a name, as plug-ins of the engine.

A measure is a function from a DataFrame's grouped rows to Columns, so Catalyst plans all measures of a call as one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MEASURES: dict[str, Callable[[], Column]] = {}


def register_measure(name: str, make: Callable[[], Column]) -> None:
    """``make`` gives an aggregate column; a name can be registered once."""
    if name in _MEASURES:
        raise ValueError(f"measure {name} exists")
    _MEASURES[name] = make


def measure(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in _MEASURES]
    if unknown:
        raise KeyError(f"no such measure: {', '.join(unknown)}")
    return df.groupBy(*by).agg(*(_MEASURES[n]().alias(n) for n in names))


register_measure("steps_taken", lambda: F.count(F.lit(1)))
register_measure("final_distance", lambda: F.max_by("distance", "step"))
register_measure("oracle_distance", lambda: F.min("distance"))
register_measure("success", lambda: (F.max_by("distance", "step") <= 3.0).cast("int"))
register_measure("oracle_success", lambda: (F.min("distance") <= 3.0).cast("int"))


#: Functions for SQL texts, as SQL expressions: they are planned like built-in ones.
SQL_FUNCTIONS = {
    "wrap_degrees(a double) returns double": "a - 360 * floor((a + 180) / 360)",
    "separation_degrees(a double, b double) returns double": "abs((a - b) - 360 * floor(((a - b) + 180) / 360))",
    "action_runs(actions array<int>) returns table(action int, n long)": "select min(a), count(*) from (select a, i - row_number() over (partition by a order by i) as g from (select posexplode(actions) as (i, a))) group by a, g",
}


def install(spark) -> None:
    """2.12: makes the functions, scalar and table-valued, known to the session's SQL."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")

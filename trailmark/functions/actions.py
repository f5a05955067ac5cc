"""Column functions over action sequences (array<int>; 0 stop, 1 forward, 2 left, 3 right).

Null sequences give null unless said otherwise; all stay inside the JVM and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contract_flags(a: Column, least: int = 1) -> Column:
    """Names of broken rules: too_short, unknown_action, stop_not_unique_terminal."""
    return F.array_compact(
        F.array(
            F.when(F.size(a) < least, "too_short"),
            F.when(F.exists(a, lambda x: x.isNull() | ~x.between(0, 3)), "unknown_action"),
            F.when(~((F.element_at(a, -1) == 0) & (F.array_position(a, F.lit(0)) == F.size(a))), "stop_not_unique_terminal"),
        )
    )


def through_stop(a: Column) -> Column:
    """The prefix that ends with the first stop, or all."""
    at = F.array_position(a, F.lit(0))
    return F.when(at > 0, F.slice(a, F.lit(1), at.cast("int"))).otherwise(a)


def before_stop(a: Column) -> Column:
    at = F.array_position(a, F.lit(0))
    return F.when(at > 0, F.slice(a, F.lit(1), (at - 1).cast("int"))).otherwise(a)


def runs(a: Column) -> Column:
    """array<struct<action,start,end>> of equal neighbours, ends inclusive: one fold, starts found by comparing neighbours."""
    idx = F.sequence(F.lit(0), F.size(a) - 1)
    starts = F.filter(idx, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    spans = F.transform(starts, lambda s, k: F.struct(F.get(a, s).alias("action"), s.alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(a)) - 1).alias("end")))
    return F.when(F.size(a) > 0, spans).otherwise(F.array().cast("array<struct<action:int,start:int,end:int>>"))


def runs_before_stop(a: Column) -> Column:
    """Runs up to the first stop, which is left out."""
    return runs(before_stop(a))


def blocks(a: Column, accepted: tuple[int, ...]) -> Column:
    """Half-open blocks of neighbouring accepted actions; the last element is left out.  array<struct<start,end>>."""
    body = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    ok = F.transform(body, lambda x: x.isin(*accepted).cast("int"))
    return F.transform(F.filter(runs(ok), lambda r: r["action"] == 1), lambda r: F.struct(r["start"].alias("start"), (r["end"] + 1).alias("end")))


def padded_target(a: Column, start: Column, horizon: int) -> Column:
    """``horizon`` actions from ``start`` on (from 0), filled with stops."""
    part = F.slice(a, start + 1, F.lit(horizon))
    return F.concat(part, F.array_repeat(F.lit(0), F.lit(horizon) - F.size(part)))


def evenly(first: Column, last: Column, slots: int) -> Column:
    """``slots`` + 1 evenly spaced numbers of [first, last], ends included, repeats removed."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(slots)), lambda s: (first + F.floor(s * (last - first) / slots)).cast("int")))


def uncertainty_horizon(u: Column, budget: float, least: int, most: int) -> Column:
    """Length of the longest prefix whose running sum stays within the budget, kept in [least, most]; only ``most`` are looked at."""
    seen = F.slice(u, F.lit(1), F.lit(most))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        go = acc["go"] & (total <= budget + 1e-12)
        return F.struct(total.alias("sum"), (acc["n"] + go.cast("int")).alias("n"), go.alias("go"))

    return F.least(F.greatest(F.aggregate(seen, start, step, lambda s: s["n"]), F.lit(least)), F.lit(most))


def stop_commit(a: Column, limit: int) -> Column:
    """Place (from 1) of the first stop among the first ``limit``, else null."""
    at = F.array_position(F.slice(a, F.lit(1), F.lit(limit)), F.lit(0))
    return F.when(at > 0, at)


def replan_prefix(a: Column, cap: int) -> Column:
    """Through the first stop, at most ``cap``."""
    return F.slice(through_stop(a), F.lit(1), F.lit(cap))


def keep_if_far(values: Column, least: float) -> Column:
    """Values kept in order whenever they differ from the last kept one by more than ``least``."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        values, empty, lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(F.element_at(acc, -1) - x) > least), F.concat(acc, F.array(x))).otherwise(acc)
    )


def action_name(a: Column) -> Column:
    return F.when(a == 0, "stop").when(a == 1, "forward").when(a == 2, "left").when(a == 3, "right")


def normalize_alias(s: Column) -> Column:
    """``move forward``, ``turn_left`` and the like to action names; unknown words give null."""
    w = F.trim(F.lower(F.regexp_replace(s, "[_-]+", " ")))
    short = F.regexp_replace(w, "^(?:move|go|walk|turn) ", "")
    return F.when(short.isin("stop", "forward", "left", "right"), short)

"""Keyed joins, comparisons and interval joins as compositions of equi-joins and windows.

None of them broadcasts by itself: which side is small is left to the optimizer, which knows sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def pending(everything: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``everything`` whose key is not done."""
    return everything.join(done.select(*keys).distinct(), keys, "left_anti")


def compare_keyed(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with ``status`` missing (only left), extra (only right), changed or same.  Keys should be unique on each side."""
    left, right = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status"))


def require_all(needed: DataFrame, available: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """``needed``, failing the job at a key that ``available`` lacks."""
    have = available.select(*keys).distinct().withColumn("_have", F.lit(True))
    found = needed.join(have, keys, "left")
    told = F.concat_ws(",", *(F.col(k).cast("string") for k in keys))
    return found.where(F.when(F.col("_have").isNull(), F.raise_error(F.concat(F.lit(f"missing {what}: "), told)).cast("boolean")).otherwise(True)).drop("_have")


def nearest_of_pair(pairs: DataFrame, candidates: DataFrame, a: str, b: str, cost: str, take: str) -> DataFrame:
    """For each unordered pair the candidate of least cost; of equal costs the least ``take``."""
    low, high = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    best = candidates.select(low, high, cost, take).groupBy("lo", "hi").agg(F.min(F.struct(cost, take)).alias("best"))
    return pairs.select(low, high).distinct().join(best, ["lo", "hi"]).select("lo", "hi", F.col(f"best.{take}").alias(take), F.col(f"best.{cost}").alias(cost))


def locate_in_prefix_sums(sizes: DataFrame, draws: DataFrame, key: str, size: str, ordinal: str, width: int) -> DataFrame:
    """Which row's [before, before + size) holds each drawn ordinal, and the offset in it.

    The running sum is made in two steps, by blocks of keys, so that no task sees all rows.  Interval and ordinal are cut
    into buckets of ``width`` and equi-joined on the bucket: no range join and no broadcast.
    """
    block = F.pmod(F.xxhash64(key), F.lit(64))
    s = sizes.withColumn("_block", block)
    totals = s.groupBy("_block").agg(F.sum(size).alias("_sum"))  # 64 rows
    shift = totals.withColumn("_shift", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = s.withColumn("_in", inner).join(F.broadcast(shift), "_block").withColumn("_lo", (F.col("_in") + F.col("_shift")).cast("long"))
    cut = spans.where(F.col(size) > 0).withColumn("_hi", F.col("_lo") + F.col(size))
    cut = cut.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    d = draws.withColumn("_bucket", F.floor(F.col(ordinal) / width))
    hit = d.join(cut, "_bucket").where((F.col(ordinal) >= F.col("_lo")) & (F.col(ordinal) < F.col("_hi")))
    return hit.select(ordinal, key, (F.col(ordinal) - F.col("_lo")).alias("offset"))


def last_within(points: DataFrame, key: str, at: str, back: float, order: str) -> DataFrame:
    """With ``before``: the place (``order``) of the first point that has the greatest ``at`` not above at - back, in the same key."""
    reach = points.withColumn("_reach", F.expr(f"max(`{at}`) over (partition by `{key}` order by `{at}` range between unbounded preceding and {float(back)}D preceding)"))
    first = points.groupBy(key, F.col(at).alias("_reach")).agg(F.min(order).alias("before"))
    return reach.join(first, [key, "_reach"], "left").drop("_reach")


def first_beyond(points: DataFrame, key: str, at: str, ahead: float, order: str) -> DataFrame:
    """With ``after``: the place (``order``) of the first point whose ``at`` is above at + ahead, in the same key; of the last point where there is none.

    A frame of a window holds its edge, so the greatest ``at`` within reach is found and the next greater one follows from it.
    """
    reach = points.withColumn("_reach", F.expr(f"max(`{at}`) over (partition by `{key}` order by `{at}` range between unbounded preceding and {float(ahead)}D following)"))
    each = points.groupBy(key, F.col(at).alias("_reach")).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    w = Window.partitionBy(key).orderBy("_reach")
    following = each.select(key, "_reach", F.coalesce(F.lead("_first").over(w), "_last").alias("after"))
    return reach.join(following, [key, "_reach"], "left").drop("_reach")


def path_structure(points: DataFrame, connections: DataFrame, key: str, order: str) -> DataFrame:
    """The regions a path goes through and the connections it takes; rows (key, regions, taken), ``regions`` and ``taken`` null for a path
    of fewer than two runs or with a step between regions that no connection joins.

    ``points``: (key, order, x, z, label), label negative outside of all regions; ``connections``: (lo, hi, connection, cx, cz).  A step takes the
    connection of its two regions that is nearest to the middle between the last point of one run and the first of the next.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("int")
    runs = points.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where("label >= 0").groupBy(key, "_run")
    at = F.struct("x", "z")
    runs = runs.agg(F.min("label").alias("label"), F.min_by(at, order).alias("_first"), F.max_by(at, order).alias("_last"))
    r = Window.partitionBy(key).orderBy("_run")
    steps = runs.withColumn("_to", F.lead("label").over(r)).withColumn("_next", F.lead("_first").over(r))
    middle = lambda c: (F.col(f"_last.{c}") + F.col(f"_next.{c}")) / 2
    steps = steps.select(key, "_run", "label", "_to", F.least("label", "_to").alias("lo"), F.greatest("label", "_to").alias("hi"), middle("x").alias("mx"), middle("z").alias("mz"))
    near = F.sqrt((F.col("cx") - F.col("mx")) ** 2 + (F.col("cz") - F.col("mz")) ** 2)
    # Steps without a connection stay, with none; the last run of a path has no step.
    met = steps.join(connections, ["lo", "hi"], "left").groupBy(key, "_run", "label", "_to").agg(F.min(F.when(F.col("connection").isNotNull(), F.struct(near.alias("d"), F.col("connection").alias("c")))).alias("_b"))
    rows = F.array_sort(F.collect_list(F.struct("_run", "label", F.col("_b.c").alias("c"))))
    whole = met.groupBy(key).agg(rows.alias("s"), F.count("_to").alias("_steps"), F.count("_b").alias("_taken"))
    ok = (F.col("_steps") > 0) & (F.col("_steps") == F.col("_taken"))
    paths = points.select(key).distinct()
    return paths.join(whole, key, "left").select(key, F.when(ok, F.col("s.label")).alias("regions"), F.when(ok, F.filter(F.col("s.c"), lambda c: c.isNotNull())).alias("taken"))


def owners(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, width: int = 4) -> DataFrame:
    """Points with each span [low, high) of their key that holds them; joined on buckets of ``width``."""
    s = spans.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return p.join(s, [key, "_bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def near_pairs(points: DataFrame, key: str, xs: list[str], radius: float, part: list[str] = ()) -> DataFrame:
    """Pairs (a < b) of points at most ``radius`` apart, by grid cells of that size: only neighbouring cells are compared."""
    from itertools import product

    cell = [F.floor(F.col(x) / radius).alias(f"_c{i}") for i, x in enumerate(xs)]
    p = points.select(*part, key, *xs, *cell)
    a = p.select(*part, F.col(key).alias("a"), *(F.col(x).alias(f"a_{x}") for x in xs), *(F.col(f"_c{i}") for i in range(len(xs))))
    around = F.array(*(F.struct(*((F.col(f"_c{i}") + d).alias(f"_c{i}") for i, d in enumerate(ds))) for ds in product((-1, 0, 1), repeat=len(xs))))
    b = p.select(*part, F.col(key).alias("b"), *(F.col(x).alias(f"b_{x}") for x in xs), F.explode(around).alias("_n")).select("*", "_n.*").drop("_n")
    d2 = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in xs[1:]), (F.col(f"a_{xs[0]}") - F.col(f"b_{xs[0]}")) ** 2)
    return a.join(b, [*part, *(f"_c{i}" for i in range(len(xs)))]).where(F.col("a") < F.col("b")).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius).select(*part, "a", "b", "distance")


def cartesian_heads(a: DataFrame, b: DataFrame, group: str, ia: str, ib: str, k: int) -> DataFrame:
    """Of the pairs of members of a group the first ``k`` by the sum of their indices; members beyond index k - 1 cannot be among them."""
    pairs = a.where(F.col(ia) < k).join(b.where(F.col(ib) < k), group)
    w = Window.partitionBy(group).orderBy(F.col(ia) + F.col(ib), ia)
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

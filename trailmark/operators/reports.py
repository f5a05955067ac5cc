"""Reports over the scenes of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a scene's counters must pass, in this order, and what it is called if they do not.
LADDER = (
    ("junctions", 1, "no_region_graph_junction"),
    ("relations", 1, "junctions_fail_decision_geometry_or_visibility"),
    ("route_groups", 1, "valid_relations_not_used_by_natural_shortest_paths"),
    ("verified", 1, "natural_routes_fail_primitive_replay_verification"),
    ("eligible", 1, "replayed_routes_fail_quality_gates"),
    ("trajectories", 10, "valid_but_structurally_sparse"),
)
HEALTHY = "healthy"


def outcome() -> Column:
    """The name of the first rung that is not passed; a missing counter counts as 0."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(0)) < least, name) for c, least, name in LADDER), F.lit(HEALTHY))


def retention(kept: str, groups: str) -> Column:
    """Kept trajectories for each route group."""
    return F.col(kept) / F.greatest(F.lit(1), F.col(groups))


def _long(df: DataFrame, part: str, **values: Column) -> DataFrame:
    """Aggregates as rows (part, key, value)."""
    one = df.agg(*(v.cast("double").alias(k) for k, v in values.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(k).alias("key"), F.col(k).alias("value")) for k in values))))


def _counted(df: DataFrame, part: str, by: Column) -> DataFrame:
    return df.groupBy(by.cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(part).alias("part"), "key", "value")


def collection_report(scenes: DataFrame, episodes: DataFrame, lines: int) -> DataFrame:
    """Rows (part, key, value) of a collection.

    ``scenes`` has the counters of :data:`LADDER`, regions and connections; ``episodes`` (scene, decisions, length); ``lines`` episodes make a trajectory.
    Floor ranks go over scenes, of which a collection has few; everything over episodes is a combined aggregate.
    """
    whole = F.count(F.lit(1))
    n_episodes = episodes.agg(whole.cast("double").alias("n"))
    total = _long(scenes, "total", scenes=whole, regions=F.sum("regions"), connections=F.sum("connections"), route_groups=F.sum("route_groups"))
    total = total.unionByName(n_episodes.select(F.lit("total").alias("part"), F.lit("episodes").alias("key"), F.col("n").alias("value")))
    # Exact percentiles: values are counted first, so copies of a length cost nothing.
    length = _long(episodes, "length", minimum=F.min("length"), median=F.percentile("length", 0.5), p90=F.percentile("length", 0.9), maximum=F.max("length"), mean=F.avg("length"))
    rank = Window.orderBy("trajectories")
    ranked = scenes.select("trajectories", (F.row_number().over(rank) - 1).alias("i")).crossJoin(F.broadcast(scenes.agg(whole.alias("n"))))
    at = lambda f: F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * f), F.col("trajectories")))
    ranks = _long(ranked, "per_scene", p10=at(0.1), p25=at(0.25), median=at(0.5), p75=at(0.75), p90=at(0.9))
    ends = _long(scenes.crossJoin(F.broadcast(n_episodes.withColumnRenamed("n", "all"))), "per_scene", minimum=F.min("trajectories"), maximum=F.max("trajectories"), mean=F.max("all") / F.greatest(F.lit(1), whole))
    counted = episodes.groupBy("scene").agg(whole.alias("n")).join(scenes.select("scene", "trajectories"), "scene", "full_outer")
    odd = _long(counted, "unreconciled", scenes=F.count_if(F.floor(F.coalesce("n", F.lit(0)) / lines) != F.coalesce("trajectories", F.lit(0))))
    rounded = length.unionByName(ends).select("part", "key", F.round("value", 6).alias("value"))
    return total.unionByName(_counted(episodes, "decisions", F.col("decisions"))).unionByName(_counted(scenes, "outcome", outcome())).unionByName(rounded).unionByName(ranks).unionByName(odd)

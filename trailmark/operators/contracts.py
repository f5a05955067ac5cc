"""Contracts as columns of flags; :func:`enforce` turns flags into a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flags(**broken: Column) -> Column:
    """Sorted names of the conditions that hold; a null condition does not."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, k) for k, c in broken.items()))))


def enforce(df: DataFrame, found: str, key: str) -> DataFrame:
    """``df`` without the flag column; fails at the first row that has a flag."""
    told = F.concat(F.lit("contract broken at "), F.col(key).cast("string"), F.lit(": "), F.array_join(found, ","))
    return df.where(F.when(F.size(found) > 0, F.raise_error(told).cast("boolean")).otherwise(True)).drop(found)


def trajectory_flags(actions: Column, n_regions: Column, n_decisions: Column, length: Column, start: Column, goal: Column) -> Column:
    """Counts agree and numbers are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return flags(
        no_actions=F.coalesce(F.size(actions), F.lit(0)) < 1,
        more_decisions_than_actions=n_decisions > F.size(actions),
        no_regions=n_regions < 1,
        length_not_finite=bad(length) | (length < 0),
        start_not_vec3=(F.size(start) != 3) | F.exists(start, bad),
        goal_not_vec3=(F.size(goal) != 3) | F.exists(goal, bad),
    )


def pose_flags(position: Column, quaternion: Column, tolerance: float = 1e-3) -> Column:
    """Three finite coordinates and a unit quaternion."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    norm = F.sqrt(F.aggregate(quaternion, F.lit(0.0), lambda s, x: s + x * x))
    return flags(position_invalid=(F.size(position) != 3) | F.exists(position, bad), quaternion_invalid=(F.size(quaternion) != 4) | (F.abs(norm - 1) > tolerance))


def chunk_flags(chunks: DataFrame, key: str, step: str, count: str, horizon: int) -> DataFrame:
    """Chunks in order of step cover the steps without gap or overlap; rows (key, flags, n_chunks)."""
    w = Window.partitionBy(key).orderBy(step)
    end = F.lag(F.col(step) + F.col(count)).over(w)
    c = chunks.withColumn("_gap", F.col(step) > F.coalesce(end, F.lit(0))).withColumn("_overlap", F.col(step) < F.coalesce(end, F.lit(0))).withColumn("_long", ~F.col(count).between(1, horizon))
    g = c.groupBy(key).agg(F.bool_or("_gap").alias("g"), F.bool_or("_overlap").alias("o"), F.bool_or("_long").alias("l"), F.count(F.lit(1)).alias("n_chunks"))
    return g.select(key, flags(gap=F.col("g"), overlap=F.col("o"), count_out_of_range=F.col("l")).alias("flags"), "n_chunks")


def acceptance(checks: DataFrame, key: str, kind: str, passed: str, required: tuple[str, ...]) -> DataFrame:
    """Every required kind exactly once and passed."""
    g = checks.groupBy(key, kind).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(passed).alias("_ok"))
    per = g.groupBy(key).agg(F.count_if(F.col(kind).isin(*required) & (F.col("_n") == 1) & F.col("_ok")).alias("_good"), F.count_if((F.col("_n") > 1) | ~F.col("_ok")).alias("_bad"))
    return per.select(key, ((F.col("_good") == len(required)) & (F.col("_bad") == 0)).alias("accepted"))


def training_row_flags(n_images: Column, history: Column, step: Column, target: Column, real: Column) -> Column:
    """images = step + 1, history = step actions without a stop, real actions = those through the first stop."""
    at = F.array_position(target, F.lit(0))
    return flags(
        images=n_images != step + 1,
        history=F.size(history) != step,
        stop_in_history=F.array_position(history, F.lit(0)) > 0,
        real_actions=real != F.when(at > 0, at).otherwise(F.size(target)),
    )


def span_flags(text: Column, spans: Column) -> Column:
    """Each span (s, e, t) holds the text at its place, and spans are in order."""
    wrong = F.exists(spans, lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]) != x["t"])
    order = F.exists(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["s"] < F.coalesce(F.get(spans, i - 1)["e"], F.lit(0)))
    return flags(text_differs=wrong, out_of_order=F.when(F.size(spans) > 0, order))


def segment_flags(segments: DataFrame, key: str, start: str, end: str, terminal: str, sizes: DataFrame, size: str) -> DataFrame:
    """Segments cover [0, size) without gap, the last of them and no other is terminal."""
    w = Window.partitionBy(key).orderBy(start)
    s = segments.withColumn("_before", F.coalesce(F.lag(end).over(w), F.lit(0)))
    g = s.groupBy(key).agg(F.bool_or(F.col(start) != F.col("_before")).alias("_gap"), F.max(end).alias("_end"), F.count_if(terminal).alias("_ends"), F.max_by(terminal, start).alias("_last"))
    j = sizes.join(g, key, "left")
    return j.select(key, flags(uncovered=F.col("_end").isNull() | (F.col("_end") != F.col(size)), gap=F.col("_gap"), not_one_terminal=F.coalesce("_ends", F.lit(0)) != 1, last_not_terminal=~F.col("_last")).alias("flags"))


def missing_frames(frames: DataFrame, key: str, number: str) -> DataFrame:
    """Frames of each key are 0..n-1, each once; rows (key, n_frames, contiguous)."""
    g = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct(number).alias("_d"), F.max(number).alias("_m"), F.min(number).alias("_l"))
    return g.select(key, "n_frames", ((F.col("_l") == 0) & (F.col("_d") == F.col("n_frames")) & (F.col("_m") + 1 == F.col("n_frames"))).alias("contiguous"))

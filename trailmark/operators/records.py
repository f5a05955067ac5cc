"""Records for simulators: trajectories with their texts in the shape that a benchmark reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moved(positions: Column, tolerance: float = 1e-5) -> Column:
    """Positions (arrays of x, y, z) without those that lie within a tolerance of the last one kept."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)) > tolerance
    start = F.array().cast("array<array<double>>")
    return F.aggregate(positions, start, lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).otherwise(F.when(far(F.element_at(kept, -1), p), F.concat(kept, F.array(p))).otherwise(kept)))


def relative_to(path: Column, root: str) -> Column:
    """A path below ``root`` without it; a path elsewhere fails the job."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, F.length(path))).otherwise(F.raise_error(F.concat(path, F.lit(f" is not below {base}"))).cast("string"))


def route_record(number: Column, trajectory: Column, scene_path: Column, root: str, positions: Column, rotation: Column, text: Column, geodesic: Column, radius: float = 0.25) -> Column:
    """One episode of a route benchmark as a struct: numbered, its scene relative to the root, its path without repeated places, its goal at the last one."""
    return F.struct(
        number.cast("int").alias("episode_id"),
        trajectory.alias("trajectory_id"),
        relative_to(scene_path, root).alias("scene_id"),
        F.get(positions, F.lit(0)).alias("start_position"),
        rotation.alias("start_rotation"),
        F.struct(geodesic.cast("double").alias("geodesic_distance")).alias("info"),
        F.array(F.struct(F.element_at(positions, -1).alias("position"), F.lit(float(radius)).alias("radius"))).alias("goals"),
        F.struct(text.alias("instruction_text"), F.lit(None).cast("array<string>").alias("instruction_tokens")).alias("instruction"),
        moved(positions).alias("reference_path"),
    )


def same_route(expected: Column, labels: Column) -> Column:
    """Whether the labels seen on the way (negative ones and repeats left out) are the expected ones, of which those between the ends may be missing if they were never seen."""
    seen = F.filter(labels, lambda x: x >= 0)
    short = F.filter(F.transform(seen, lambda x, i: F.when((i == 0) | (F.get(seen, i - 1) != x), x)), lambda x: x.isNotNull())
    last = F.size(expected) - 1
    needed = F.filter(expected, lambda x, i: (i == 0) | (i == last) | F.array_contains(short, x))
    return (short == expected) | (short == needed)


def position_of_pose(pose: Column) -> Column:
    """M4: the place of a camera whose pose is a row-major 4 x 4 matrix with z up, in a world with y up."""
    return F.array(F.get(pose, F.lit(3)), F.get(pose, F.lit(11)), -F.get(pose, F.lit(7)))

"""Selections that balance flags, lengths and scenes, and nearest-shape joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced_review(rows: DataFrame, key: str, flags: str, length: str, n: int) -> DataFrame:
    """``n`` rows, flags in turn (first of each flag, then second ...), filled up evenly over length deciles.

    A row counts for the flag that brings it first; ranks are cut at ``n`` inside each flag, so what is sorted at the end is
    bounded by the number of flags times ``n``.
    """
    per = rows.select(key, length, F.explode(flags).alias("_f"))
    mixed = F.md5(F.col(key).cast("string").cast("binary"))
    w = Window.partitionBy("_f").orderBy(mixed, key)
    turn = per.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(key, length).agg(F.min(F.struct("_r", "_f")).alias("_o"))
    first = turn.orderBy("_o", key).limit(n).select(key, F.lit(0).alias("_p"), F.col("_o._r").cast("long").alias("_r"))
    deciles = rows.agg(F.percentile(length, [i / 10 for i in range(1, 10)])).first()[0] or []
    decile = sum((F.when(F.col(length) > d, 1).otherwise(0) for d in deciles), F.lit(0))
    rest = rows.join(first.select(key), key, "left_anti").select(key, decile.alias("_d"))
    rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy(mixed, key)).cast("long")).where(F.col("_r") <= n)
    filled = rest.orderBy("_r", "_d", key).limit(n).select(key, F.lit(1).alias("_p"), "_r")
    return first.unionByName(filled).orderBy("_p", "_r", key).limit(n).select(key)


def split_by_scene(rows: DataFrame, scene: str, parts: int) -> DataFrame:
    """Rows with ``part`` (from 0): scenes stay whole and in order, parts hold about equally many rows.

    Only counts of scenes are put in order.
    """
    c = rows.groupBy(scene).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(scene)
    c = c.withColumn("_mid", F.sum("_c").over(w) - F.col("_c") / 2).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    part = F.least(F.floor(F.col("_mid") * parts / F.col("_n")), F.lit(parts - 1)).cast("int")
    return rows.join(c.select(scene, part.alias("part")), scene)


def scene_offset(scene: Column, n: int) -> Column:
    """The MD5 of a scene's name, as a number, modulo ``n``; from its four 32-bit parts, as no column holds 128 bits."""
    out, digest = F.lit(0).cast("bigint"), F.md5(scene.cast("binary"))
    for k in range(4):
        out = F.pmod(out * F.lit(1 << 32) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint"), F.lit(n).cast("bigint"))
    return out


def fill_subsets(rows: DataFrame, key: str, scene: str, n: int, size: int, eligible: Column | None = None) -> DataFrame:
    """The eligible rows in order of ``key``, each in the first of ``n`` subsets that has room, from its scene's offset and number of rows before it on.

    A row is only left out when all subsets are full, so the rows that are assigned are the first n * size: one task sees those,
    as (key, scene, offset), and no others.
    """
    import pandas as pd

    kept = rows if eligible is None else rows.where(eligible)
    first = kept.select(F.col(key).alias("_key"), F.col(scene).alias("_scene"), scene_offset(F.col(scene), n).alias("_offset")).orderBy("_key").limit(n * size)

    def run(batches):
        room, seen = [size] * n, {}
        for b in batches:
            picks = []
            for s, offset in zip(b["_scene"], b["_offset"], strict=True):
                start = offset + seen.get(s, 0)
                subset = next(k % n for k in range(start, start + n) if room[k % n])
                room[subset] -= 1
                seen[s] = seen.get(s, 0) + 1
                picks.append(subset)
            yield pd.DataFrame({key: b["_key"], "subset": picks})

    kind = rows.schema[key].dataType.simpleString()
    return first.coalesce(1).sortWithinPartitions("_key").mapInPandas(run, f"`{key}` {kind}, subset int")


def mixture(oracle: Column, policy: Column, beta: float, *seed: Column) -> Column:
    """Whose queue is run: the oracle's with probability beta, where it begins with a stop, or where lengths differ."""
    from ..functions.hashing import stable_keep

    chosen = (F.get(oracle, F.lit(0)) == 0) | (F.size(oracle) != F.size(policy)) | stable_keep(beta, "mixture", *seed)
    return F.when(F.coalesce(chosen, F.lit(True)), F.struct(F.lit("oracle").alias("actor"), oracle.alias("queue"))).otherwise(F.struct(F.lit("policy").alias("actor"), policy.alias("queue")))


def _triangle_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of points to triangles, row by row: to the plane where the foot lies inside, else to the nearest edge."""
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    unit = n / np.where(size > 0, size, 1)[:, None]
    height = ((p - a) * unit).sum(axis=1)
    foot = p - height[:, None] * unit
    inside = size > 0
    best = np.full(len(p), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, foot - u) * n).sum(axis=1) >= -1e-12 * size
        d = v - u
        t = np.clip(((p - u) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - u - t[:, None] * d, axis=1))
    return np.where(inside, np.abs(height), best)


def locate(points: DataFrame, triangles: DataFrame, point: str, triangle: str, radius: float, cell: float) -> DataFrame:
    """The nearest triangle (of equal distances the least id) within ``radius`` of each point; points have x, y, z, triangles corners ax..cz.

    Rounds go from a small radius, the smaller the more triangles there are, up to ``radius``: a point that has a triangle within a round's
    radius has met all that are as near and is done, so that dense places are settled before the radius is wide.  In a round a triangle stands in every cell
    that its box, grown by the radius, touches; points look in their own cell only, so the join is an equi-join; exact distances
    of the triangles whose grown box holds the point come from an Arrow-batched kernel.  Points with none near are absent.
    """
    from .graph import settled

    @F.pandas_udf("double")
    def distance(px: pd.Series, py: pd.Series, pz: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series, cx: pd.Series, cy: pd.Series, cz: pd.Series) -> pd.Series:
        s = lambda *v: np.stack([x.to_numpy(float) for x in v], axis=1)
        return pd.Series(_triangle_distance(s(px, py, pz), s(ax, ay, az), s(bx, by, bz), s(cx, cy, cz)))

    corners = [f"{q}{k}" for q in "abc" for k in "xyz"]
    t = settled(triangles.groupBy(*corners).agg(F.min(triangle).alias(triangle)), "triangles")
    todo, found, r = settled(points.select(point, "x", "y", "z"), "points"), [], float(radius)
    many = t.count()
    while many > 64:
        many, r = many / 4, r / 4
    while True:
        grown = r * (1 + 1e-9) + 1e-12  # rounding may not hide a triangle at the very radius
        low, high = ({k: pick(*(F.col(f"{q}{k}") for q in "abc")) + by for k in "xyz"} for pick, by in ((F.least, -grown), (F.greatest, grown)))
        width = {"x": max(cell / 2, r), "y": r, "z": max(cell / 2, r)}  # floors lie flat: many of them are told apart by their height
        near = t.select(triangle, *corners)
        for k in "xyz":
            near = near.withColumn(f"_{k}", F.explode(F.sequence(F.floor(low[k] / width[k]), F.floor(high[k] / width[k]))))
        own = todo.select(point, "x", "y", "z", *(F.floor(F.col(k) / width[k]).alias(f"_c{k}") for k in "xyz"))
        meet = F.lit(True)
        for k in "xyz":
            meet = meet & (F.col(f"_c{k}") == F.col(f"_{k}")) & (F.col(k) >= low[k]) & (F.col(k) <= high[k])
        d = own.join(near, meet, "left").select(point, "x", "y", "z", triangle, distance("x", "y", "z", *corners).alias("distance"))
        best = F.min(F.when(F.col("distance") <= r, F.struct("distance", triangle))).alias("_b")
        done = settled(d.groupBy(point, "x", "y", "z").agg(best), "located")
        found.append(done.where("_b is not null").select(point, F.col(f"_b.{triangle}").alias(triangle), "_b.distance"))
        todo = done.where("_b is null").drop("_b")
        if r >= radius or todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        r = min(r * 4, float(radius))

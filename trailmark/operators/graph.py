"""Graph operators: components by label contraction, degrees, shortest paths and coverage.

Iterations write their tables to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``.  Only a session in one process that names none gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/trailmark-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, few: int = 100_000, most_rounds: int = 200) -> DataFrame:
    """Rows (node, root), root the least node of the component; ``edges`` has columns u, v of one comparable type.

    Each round every node hooks to one neighbour (or itself) and edges are renamed: to the least one in the first two rounds and
    every fourth, which takes a star down at once, else to the one of least hash, and the hash is another one each
    round, so no order of the ids can make rounds of little use: on a path, the worst case, about half of the nodes are left.
    What a node hooks to is combined before it is shuffled, so a node with very many edges is no hot key.  At most ``few`` edges are
    finished in one task.
    """
    left = settled(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    hooks = []
    for k in range(most_rounds):
        if left.count() <= few:
            break
        rank = lambda c: F.lit(0).cast("long") if k < 2 or k % 4 == 1 else F.xxhash64(F.lit(k), c)  # noqa: B023, E731
        ranked = lambda c: F.struct(rank(c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.select(F.col("u").alias("node"), F.col("v").alias("other")).union(left.select("v", "u"))
        hook = settled(both.groupBy("node").agg(F.min(ranked("other")).alias("low")).select("node", F.least("low", ranked("node"))["to"].alias("to")), "hooks")
        hooks.append(hook)
        renamed = left.join(hook.toDF("u", "a"), "u").join(hook.toDF("v", "b"), "v").where("a <> b")
        left = settled(renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    kind = left.schema["u"].dataType.simpleString()
    labels = settled(left.coalesce(1).mapInPandas(_unite, f"node {kind}, root {kind}"), "labels")
    for hook in reversed(hooks):
        labels = settled(hook.join(labels.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the ends of edges one by one."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            x, y = sorted((top(u), top(v)))
            up[y] = x
    yield pd.DataFrame({"node": list(up), "root": [top(x) for x in list(up)]})


def degrees(edges: DataFrame, node: str, neighbour: str, junction: int = 3) -> DataFrame:
    """Distinct neighbours of each node and whether it is a junction."""
    return edges.groupBy(node).agg(F.countDistinct(neighbour).alias("degree")).withColumn("junction", F.col("degree") >= junction)


def dense_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    """Labels numbered from 0 without gaps in each group: from distinct labels, joined back."""
    from pyspark.sql import Window

    d = df.select(group, label).distinct().withColumn("dense", (F.row_number().over(Window.partitionBy(group).orderBy(label)) - 1).cast("int"))
    return df.join(d, [group, label])


def hop_distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """G3 over the whole graph: least number of hops (up to ``most``) from any source, with the least source that is so near.

    ``edges`` (u, v) both ways; ``sources`` (node).  One join a hop; nodes already reached are not looked at again.
    """
    seen = settled(sources.select("node", F.col("node").alias("source"), F.lit(0).alias("hops")).distinct(), "seen")
    front = seen
    for k in range(1, most + 1):
        step = edges.join(front.select(F.col("node").alias("u"), "source"), "u").groupBy(F.col("v").alias("node")).agg(F.min("source").alias("source"))
        front = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front), "seen")
    return seen


def _dijkstra(adjacent: dict, start, skip=None) -> dict:
    far, todo = {start: 0.0}, [(0.0, start)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > far.get(u, float("inf")):
            continue
        for v, w in adjacent.get(u, ()):
            if v != skip and d + w < far.get(v, float("inf")):
                far[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return far


def _adjacent(rows: pd.DataFrame) -> dict:
    out: dict = {}
    for u, v, w in zip(rows["u"], rows["v"], rows["w"], strict=True):
        out.setdefault(u, []).append((v, w))
        out.setdefault(v, []).append((u, w))
    return out


def per_scene(edges: DataFrame, scene: str, schema: str, f: Callable[[object, dict], Iterator[tuple]]) -> DataFrame:
    """Runs ``f(scene, adjacency)`` on each scene's graph.  A scene is one building: its graph fits in a task by its nature."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(f(rows[scene].iloc[0], _adjacent(rows))), columns=names)

    return edges.groupBy(scene).applyInPandas(run, schema)


def rejoin_distances(edges: DataFrame, scene: str) -> DataFrame:
    """For each junction and pair of its neighbours the length of the shortest path that avoids it; infinite if there is none."""

    def f(name, adjacent):
        for node, around in adjacent.items():
            ends = sorted({v for v, _ in around if v != node})
            for i, a in enumerate(ends if len(ends) >= 3 else ()):
                far = _dijkstra(adjacent, a, node)
                for b in ends[i + 1 :]:
                    yield name, node, a, b, far.get(b, float("inf"))

    return per_scene(edges, scene, f"{scene} long, node long, a long, b long, rejoin double", f)


def coverage_seeds(edges: DataFrame, scene: str, most: int, radius: float) -> DataFrame:
    """Farthest-point seeds of each scene until every node is within ``radius`` or there are ``most``; from the least node on."""

    def f(name, adjacent):
        nodes = sorted(adjacent)
        far = dict.fromkeys(nodes, float("inf"))
        seed = nodes[0]
        for k in range(most):
            yield name, k, seed, far[seed]
            for v, d in _dijkstra(adjacent, seed).items():
                far[v] = min(far[v], d)
            seed = max(nodes, key=lambda v: (far[v], -v))
            if far[seed] <= radius:
                return

    return per_scene(edges, scene, f"{scene} long, k int, seed long, gap double", f)


def flood(adjacent: dict, height: dict, seeds: list) -> dict:
    """The place in ``seeds`` of the seed that reaches each node over the highest lowest point; of equal ones the nearer, then the first."""
    todo = [(-height[s], 0.0, k, s) for k, s in enumerate(seeds)]
    heapq.heapify(todo)
    label: dict = {}
    while todo:
        low, far, k, v = heapq.heappop(todo)
        if v not in label:
            label[v] = k
            for u, w in adjacent.get(v, ()):
                if u not in label:
                    heapq.heappush(todo, (max(low, -height[u]), far + w, k, u))
    return label


def _borders(adjacent: dict, height: dict, label: dict) -> dict:
    """label -> other label -> (highest lower end of an edge between them, number of edges)."""
    out: dict = {k: {} for k in label.values()}
    for v, around in adjacent.items():
        if v in label:
            for u, _ in around:
                if u in label and label[v] != label[u]:
                    top, n = out[label[v]].get(label[u], (float("-inf"), 0))
                    out[label[v]][label[u]] = max(top, min(height[v], height[u])), n + 1
    return out


def _spread(adjacent: dict, far: dict, starts: list) -> list:
    """Lowers ``far`` to the distance from the nearest of ``starts``, where that is less; the nodes that got another one."""
    todo, new = [(0.0, s) for s in starts], []
    far.update(dict.fromkeys(starts, 0.0))
    heapq.heapify(todo)
    while todo:
        d, u = heapq.heappop(todo)
        if d > far[u]:
            continue
        new.append(u)
        for v, w in adjacent.get(u, ()):
            if d + w < far[v]:
                far[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return new


def basins(adjacent: dict, height: dict, area: dict, radius: float, ratio: float, least_area: float) -> dict:
    """Labels of a scene's nodes, which are numbered by their least node.

    Seeds are the nodes with no higher neighbour and then the farthest ones until all are within ``radius`` of a seed.
    Basins whose saddle is at least ``ratio`` of the higher summit are one; a basin under ``least_area`` joins the
    neighbour with the highest saddle, then the most edges, then the least label.

    All first seeds spread at once and a later one only as far as it is the nearest; a join changes the borders of the two basins alone.
    """
    seeds = [v for v in sorted(height) if all((height[u], -u) < (height[v], -v) for u, _ in adjacent.get(v, ()) if u != v)]
    far = dict.fromkeys(height, float("inf"))
    _spread(adjacent, far, seeds)
    known, farthest = set(seeds), [(-d, v) for v, d in far.items()]
    heapq.heapify(farthest)
    while farthest:
        d, v = heapq.heappop(farthest)
        if -d != far[v]:
            continue
        if v in known or far[v] <= radius:
            break
        seeds.append(v)
        known.add(v)
        for u in _spread(adjacent, far, [v]):
            heapq.heappush(farthest, (-far[u], u))
    label = flood(adjacent, height, seeds)
    up = list(range(len(seeds)))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, around in _borders(adjacent, height, label).items():
        for b, (saddle, _) in around.items():
            if saddle >= ratio * max(height[seeds[a]], height[seeds[b]], 1e-6):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    label = {v: top(k) for v, k in label.items()}
    size: dict = {}
    for v, k in label.items():
        size[k] = size.get(k, 0.0) + area[v]
    borders, into = _borders(adjacent, height, label), {}
    small = sorted(k for k in size if size[k] < least_area)  # a sorted list is a heap
    while small:
        k = small[0]
        # Only a join with this one would give it a neighbour, so one without any stays as it is.
        if k in into or size[k] >= least_area or not borders[k]:
            heapq.heappop(small)
            continue
        new = max(borders[k], key=lambda b: (*borders[k][b], -b))  # noqa: B023
        into[k] = new
        size[new] += size[k]
        for b, (saddle, n) in borders.pop(k).items():
            del borders[b][k]
            if b != new:
                high, m = borders[new].get(b, (float("-inf"), 0))
                borders[new][b] = borders[b][new] = max(high, saddle), m + n
    final: dict = {}
    for k in size:
        way, at = [], k
        while at in into and at not in final:
            way.append(at)
            at = into[at]
        final.update(dict.fromkeys([*way, k], final.get(at, at)))
    number: dict = {}
    return {v: number.setdefault(final[label[v]], len(number)) for v in sorted(label)}


def watershed(edges: DataFrame, nodes: DataFrame, scene: str, radius: float, ratio: float, least_area: float) -> DataFrame:
    """Rows (scene, node, label) by :func:`basins` on each scene; ``nodes``: (scene, node, height, area), one row a node.

    Nodes and edges of a scene come one after the other in one stream of batches: groups cost no call of their own, and a task holds one scene.
    """
    as_node = nodes.select(scene, F.lit(0).alias("kind"), F.col("node").alias("u"), F.lit(0).cast("long").alias("v"), F.col("height").cast("double").alias("w"), F.col("area").cast("double").alias("area"))
    as_edge = edges.select(scene, F.lit(1).alias("kind"), "u", "v", F.col("w").cast("double").alias("w"), F.lit(0.0).alias("area"))
    most = 20_000  # rows of a batch that is handed out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b[scene].to_pylist(), *(b[c].to_numpy(zero_copy_only=False).tolist() for c in ("kind", "u", "v", "w", "area")), strict=True))
        out: tuple = ([], [], [])
        pack = lambda: pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[scene, "node", "label"])
        for name, group in itertools.groupby(rows, operator.itemgetter(0)):
            adjacent, height, area = {}, {}, {}
            for _, kind, u, v, w, a in group:
                if kind:
                    adjacent.setdefault(u, []).append((v, w))
                    adjacent.setdefault(v, []).append((u, w))
                else:
                    height[u], area[u] = w, a
            found = basins(adjacent, height, area, radius, ratio, least_area)
            out[0].extend([name] * len(found))
            out[1].extend(found)
            out[2].extend(found.values())
            if len(out[0]) >= most:
                yield pack()
                out = ([], [], [])
        yield pack()

    return as_node.unionByName(as_edge).repartition(scene).sortWithinPartitions(scene).mapInArrow(run, f"{scene} long, node long, label int")

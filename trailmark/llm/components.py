"""Connected components by contraction: every node hooks to one neighbour, edges are renamed, until few are left.

Which of its neighbours (or itself) a node hooks to is the least one in some rounds, which takes a star down at once, and the one of
least hash in the others; the hash changes with the round, so no order of the ids can make all rounds of little use: on a
path, where hooking shortens least, such a round leaves about half of the nodes.  When at most ``FEW`` edges are left, one task joins
their ends one by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, hot_join, written

#: Edges that one task finishes.
FEW = 100_000
#: Rounds after which something must be wrong.
MOST_ROUNDS = 200


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, root) for all nodes of ``edges`` (u, v); root is the same node for all of a component.

    Every round is written to the shared folder.  What a node hooks to is combined before it is shuffled, so a node with very many
    edges is no hot key; ends are renamed by :func:`hot_join`, as is the root of a component that holds most nodes.
    Null ends are ignored; an empty table gives an empty one.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    hooks: list[DataFrame] = []
    for k in range(MOST_ROUNDS):
        if edges.count() <= FEW:
            break
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select("v", "u"))
        met = ends.groupBy("node").agg(F.min(_order(F.col("to"), k)).alias("low"), F.count(F.lit(1)).alias("n"))
        hook = written(met.select("node", F.least("low", _order(F.col("node"), k))["to"].alias("to"), "n"), f"{name}-hooks")
        hooks.append(hook.select("node", "to"))
        first = hot_join(edges, hook.select(F.col("node").alias("u"), F.col("to").alias("a"), "n"), "u", "n", "inner").drop("n")
        if hook.count() > HOT_KEYS:
            first = written(first, f"{name}-renamed")
        renamed = hot_join(first, hook.select(F.col("node").alias("v"), F.col("to").alias("b"), "n"), "v", "n", "inner").where("a <> b")
        edges = written(renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-edges")
    else:
        raise RuntimeError("components did not settle")
    labels = written(_joined_ends(edges), f"{name}-labels")
    # From the last round to the first: where a round's nodes went in the rounds after it.
    for hook in reversed(hooks):
        many = hook.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        step = written(labels.select(F.col("node").alias("to"), "root").join(many, "to"), f"{name}-steps")
        labels = written(hot_join(hook, step, "to", "n").select("node", F.coalesce("root", "to").alias("root")), f"{name}-labels")
    return labels


def _order(c: Column, k: int) -> Column:
    """What neighbours are compared by in round ``k``: themselves in the first two rounds and every fourth, else a hash."""
    rank = F.lit(0).cast("long") if k < 2 or k % 4 == 1 else F.xxhash64(F.lit(k), c)
    return F.struct(rank.alias("rank"), c.alias("to"))


def _joined_ends(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of at most FEW edges, in one task."""

    def run(batches):
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for b in batches:
            kind = b.schema.field("u").type
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                a, b2 = sorted((top(u), top(v)))
                up[b2] = a
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in list(up)], kind)], names=["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")

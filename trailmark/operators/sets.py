"""Unions with rules for repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_without_conflicts(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row a key with ``copies``; rows of a key that differ in ``values`` fail the job, rows with a null value are left out."""
    whole = a.select(key, *values).unionByName(b.select(key, *values)).dropna(subset=values)
    body = F.struct(*values)
    g = whole.groupBy(key).agg(F.min(body).alias("_a"), F.max(body).alias("_b"), F.count(F.lit(1)).alias("copies"))
    agree = F.when(F.col("_a") == F.col("_b"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string"))).cast("boolean"))
    return g.where(agree).select(key, "_a.*", "copies")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; a map-side maximum, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")

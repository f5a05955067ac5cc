"""Stable hash sampling: choices that depend on the named parts only, not on order, partitions or workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_number(*parts) -> Column:
    """The first 64 bits of the SHA-256 of the parts, as decimal(20,0)."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws(SEPARATOR, *cols), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_index(n, *parts) -> Column:
    """T4: a stable number below ``n``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(stable_number(*parts), n.cast("decimal(20,0)")).cast("int")


def stable_keep(probability: float, *parts) -> Column:
    """T4: true with the given probability."""
    return stable_number(*parts).cast("double") / F.lit(float(2**64)) < probability


def sql_number(*parts: str) -> str:
    """SQL of :func:`stable_number` over SQL expressions of text."""
    return f"('0x' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 16))::ubigint"

"""Event-time windows and resumable jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts by window and key; on a stream rows later than ``late`` behind the watermark are left out."""
    d = df.withWatermark(at, late) if late else df
    return d.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(df: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    d = df.withWatermark(at, late) if late else df
    return d.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def resume(everything: DataFrame, log: DataFrame, key: str, mark: str, order: str) -> DataFrame:
    """What is still to do: keys without a log entry, whose last entry has another fingerprint, or did not end well."""
    last = log.groupBy(key).agg(F.max_by(F.struct(mark, "status"), order).alias("_l"))
    j = everything.join(last, key, "left")
    done = F.col("_l").isNotNull() & F.col(f"_l.{mark}").eqNullSafe(F.col(mark)) & F.col("_l.status").isin("accepted", "quarantined")
    return j.where(~done).drop("_l")


def uncached(requests: DataFrame, cache: DataFrame, body: str) -> DataFrame:
    """Requests whose digest the cache lacks, each once, with ``digest``."""
    asked = requests.withColumn("digest", F.sha2(F.col(body).cast("binary"), 256)).dropDuplicates(["digest"])
    return asked.join(cache.select("digest"), "digest", "left_anti")

"""Aggregates that the built-ins do not have in the wanted form.

The rank quantiles count values before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_mean(x: Column) -> Column:
    """A1: mean without nulls, 0 where there is none."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def ordered_means(place: Column, **xs: Column) -> Column:
    """Struct of the means of some columns without nulls, added one by one in the order of ``place``; null where there is none.

    A sum of doubles depends on the order of its terms, so that a mean beside a limit could fall on either side with each cut of the input.
    """
    rows = F.array_sort(F.collect_list(F.struct(place.alias("_at"), *(x.cast("double").alias(k) for k, x in xs.items()))))
    total = lambda k: F.aggregate(rows, F.lit(0.0), lambda s, r: F.when(r[k].isNull(), s).otherwise(s + r[k]))
    return F.struct(*(F.try_divide(total(k), F.count(x)).alias(k) for k, x in xs.items()))


def ranked_quantiles(df: DataFrame, value: str, ps: dict[str, float], rounding: str = "nearest", by: list[str] = ()) -> DataFrame:
    """A4, A5: the value at index round_half_even((n-1) p) ("nearest") or floor((n-1) p) ("floor"), a row for each group.

    Values are counted first; the running count goes over the distinct values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("_hi", F.sum("_c").over(w))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    j = upto.join(total, list(by)) if by else upto.withColumn("_1", F.lit(1)).join(F.broadcast(total.withColumn("_1", F.lit(1))), "_1")
    at = {k: (F.bround if rounding == "nearest" else F.floor)((F.col("_n") - 1) * F.lit(p)) for k, p in ps.items()}
    return j.groupBy(*by).agg(*(F.min(F.when(F.col("_hi") > a, F.col(value))).alias(k) for k, a in at.items()))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 for fewer than two rows or a constant side."""
    ok = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) > 1) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    sx, sy, sxy = F.stddev_pop(x), F.stddev_pop(y), F.covar_pop(x, y)
    return F.when(ok, F.try_divide(sxy, sx * sy)).otherwise(0.0)


def entropy(counts: DataFrame, count: str, by: list[str] = ()) -> DataFrame:
    """Bits of entropy, distinct and once-seen entries of each group, from counts; no join with the total."""
    c = F.col(count).cast("double")
    n = F.sum(c)
    return counts.groupBy(*by).agg((F.log2(n) - F.sum(c * F.log2(c)) / n).alias("entropy"), F.count(F.lit(1)).alias("vocabulary"), F.count_if(c == 1).alias("hapax"))


def paired_bootstrap(pairs: DataFrame, keys: list[str], difference: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Mean difference, 95 % interval of the replicates' means, share of replicates above 0.

    A Poisson bootstrap: each pair has in each replicate a hashed Poisson(1) weight, so replicates are sums that combine
    before the shuffle; nothing is indexed, collected or drawn from an order.
    """
    cumulative, p = [], 2.718281828459045**-1
    for k in range(8):
        cumulative.append(p + (cumulative[-1] if cumulative else 0))
        p /= k + 1
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cumulative[1:]), F.when(u >= cumulative[0], 1).otherwise(0))
    reps = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = reps.groupBy("replicate").agg((F.sum(F.col("_w") * F.col(difference)) / F.greatest(F.sum("_w"), F.lit(1))).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_improve"))
    whole = pairs.agg(F.avg(difference).alias("mean_difference"), F.count(F.lit(1)).alias("pairs"))
    return whole.withColumn("_1", F.lit(1)).join(F.broadcast(ci.withColumn("_1", F.lit(1))), "_1").drop("_1")


def weighted_median_ratio(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """The y/x at which the running sum of x reaches half of its total."""
    r = df.where(F.col(x) > 0).withColumn("_r", F.col(y) / F.col(x))
    w = Window.partitionBy(*by).orderBy("_r", x)
    t = r.withColumn("_run", F.sum(x).over(w)).withColumn("_all", F.sum(x).over(Window.partitionBy(*by)))
    return t.groupBy(*by).agg(F.min(F.when(F.col("_run") >= F.col("_all") / 2, F.col("_r"))).alias("ratio"))

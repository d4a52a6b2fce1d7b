"""Weighted medians, outliers, effective sample size and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import at_least, clamp01
from tidemark.profiles import GATE_TOLERANCE, Profile

#: Price slices of a bucket whose weights are summed before the slice that holds the median is sorted.
SLICES = 64


def weighted_median(rows: DataFrame, keys: list[str], value: str = "price", weight: str = "w") -> DataFrame:
    """(keys, median): the first value in order at which the running weight reaches half of all.

    A bucket isn't sorted whole: its rows fall into slices at approximate quantiles, the slices'
    weights are summed, and only the slice that holds the median is accumulated value by value.
    The result is exact wherever the slices' bounds lie.
    """
    live = rows.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    cuts = live.groupBy(*keys).agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 200).alias("cuts"), F.sum("w").alias("total"))
    sliced = live.join(cuts, keys).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    half = F.col("total") / 2 * (1 - GATE_TOLERANCE)
    order = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sliced.groupBy(*keys, "slice").agg(F.sum("w").alias("w"), F.first("total").alias("total")).withColumn("upto", F.sum("w").over(order))
    held = sums.where(F.col("upto") >= half).groupBy(*keys).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("w")).alias("below")), "slice").alias("s"))
    inside = sliced.join(held, keys).where(F.col("slice") == F.col("s.slice"))
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("s.below") + F.sum("w").over(running))
    # rounding may leave the slice's last running sum a little short of half
    found = inside.groupBy(*keys).agg(F.min(F.when(F.col("upto") >= half, F.col(value))).alias("m"), F.max(value).alias("last"))
    return found.select(*keys, F.coalesce("m", "last").alias("median"))


def median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the median of the values, of an even number the mean of the two in the middle; sliced as in weighted_median."""
    live = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w"))
    cuts = live.groupBy(*keys).agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 200).alias("cuts"), F.sum("w").alias("total"))
    sliced = live.join(cuts, keys).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    order = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sliced.groupBy(*keys, "slice").agg(F.sum("w").alias("w"), F.first("total").alias("total")).withColumn("upto", F.sum("w").over(order))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    held = sums.where((F.col("upto") >= lower) & (F.col("upto") - F.col("w") < upper)).select(*keys, "slice", (F.col("upto") - F.col("w")).alias("below"))
    running = Window.partitionBy(*keys, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sliced.join(held, [*keys, "slice"]).withColumn("upto", F.col("below") + F.sum("w").over(running))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    return inside.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(name))


def deviations(rows: DataFrame, center: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the median distance of prices from the bucket's center (keys, median)."""
    return median(rows.join(center, keys).select(*keys, F.abs(F.col("price") - F.col("median")).alias("_distance")), keys, "_distance", name)


def inliers(rows: DataFrame, center: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    """Rows whose distance from the center is at most max_z median distances; all where that is 0."""
    mad = deviations(rows, center, keys, "_mad")
    out = rows.join(center.join(mad, keys), keys)
    z = F.when(F.col("_mad") > 0, F.abs(F.col("price") - F.col("median")) / F.col("_mad")).otherwise(0.0)
    return out.withColumn("z", z).where(F.col("z") <= p.max_z).drop("_mad", "median")


def effective(rows: DataFrame, share: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weight, n_eff, top_share). The weight is summed over domains: fewer terms, less rounding at the gate."""
    squares = rows.groupBy(*keys).agg((F.pow(F.sum("w"), 2) / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("n_eff"))
    per = share.groupBy(*keys).agg(F.sum("D_j").alias("weight"), F.max("D_j").alias("top_share"))
    return per.join(squares, keys)


def is_cold(weight, n_eff, p: Profile):
    return ~(at_least(weight, p.min_weight) & at_least(n_eff, p.min_n_eff))


def confidence(n_eff, weight, top_share, p: Profile):
    return clamp01((1 - F.exp(-p.confidence_rate * n_eff)) * weight * (1 - top_share))

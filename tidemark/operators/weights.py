"""Temporal weights, burst damping and the cap of a domain's share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.profiles import BASELINE_WINDOWS, ESTABLISHED_WINDOWS, WINDOW_SECONDS, Profile


def temporal(rows: DataFrame, now: int | Column, p: Profile) -> DataFrame:
    """Rows of age 0 to max_age, with age, window_index and W_time."""
    age = (F.lit(now) - F.col("timestamp")).cast("long")
    rows = rows.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= p.max_age))
    return rows.withColumns({"window_index": F.floor(F.col("timestamp") / WINDOW_SECONDS).cast("long"), "W_time": F.pow(F.lit(2.0), -F.col("age") / p.half_life)})


def window_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "domain_id", "window_index").agg(F.count(F.lit(1)).alias("n"))


def bursts(counts: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    """(keys, domain_id, n_recent, baseline_windows, baseline, threshold, ratio, W_burst) from counts by window."""
    latest = Window.partitionBy(*keys, "domain_id").orderBy(F.col("window_index").desc())
    ranked = counts.withColumn("r", F.row_number().over(latest)).where(F.col("r") <= BASELINE_WINDOWS + 1)
    before = F.when(F.col("r") > 1, F.col("n"))
    per = ranked.groupBy(*keys, "domain_id").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n_recent"), F.count(before).alias("baseline_windows"), F.median(before).alias("own"))
    totals = counts.groupBy(*keys, "window_index").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.median("n").alias("all"))
    out = per.join(totals, keys)
    baseline = F.coalesce(F.nullif("own", F.lit(0.0)), F.col("all"))
    threshold = F.when(F.col("baseline_windows") < ESTABLISHED_WINDOWS, p.early_multiplier).otherwise(p.burst_multiplier)
    out = out.withColumns({"baseline": baseline, "threshold": threshold}).withColumn("ratio", F.col("n_recent") / F.greatest("baseline", F.lit(1.0)))
    burst = F.when(F.col("ratio") > F.col("threshold"), 1 / F.col("ratio")).otherwise(1.0)
    return out.select(*keys, "domain_id", "n_recent", "baseline_windows", "baseline", "threshold", "ratio", burst.alias("W_burst"))


def raw_weights(rows: DataFrame, burst: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(burst.select(*keys, "domain_id", "W_burst"), [*keys, "domain_id"]).withColumn("W_raw", F.col("W_time") * F.col("W_burst"))


def shares(rows: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    """(keys, domain_id, D_raw, D_capped, D_j, factor, over): each domain's weight, capped once and normalized.

    Rows are summed by domain before anything meets by bucket, so a hot bucket or domain costs one
    row a task.
    """
    d = rows.groupBy(*keys, "domain_id").agg(F.sum("W_raw").alias("D_raw"))
    totals = d.groupBy(*keys).agg(F.sum("D_raw").alias("total"))
    d = d.join(totals, keys).withColumn("cap", F.col("total") * p.domain_cap).withColumn("D_capped", F.least("D_raw", "cap"))
    capped = d.groupBy(*keys).agg(F.sum("D_capped").alias("total_capped"))
    d = d.join(capped, keys).where("total_capped > 0").withColumn("D_j", F.col("D_capped") / F.col("total_capped"))
    factor = F.when(F.col("D_raw") > 0, F.col("D_j") / F.col("D_raw")).otherwise(0.0)
    return d.select(*keys, "domain_id", "D_raw", "D_capped", "D_j", factor.alias("factor"), (F.col("D_raw") > F.col("cap")).alias("over"))


def weighted(rows: DataFrame, share: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with w, their normalized weight."""
    s = share.select(*keys, "domain_id", "factor")
    return rows.join(s, [*keys, "domain_id"]).withColumn("w", F.col("W_raw") * F.col("factor")).drop("factor")

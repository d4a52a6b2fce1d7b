"""Identity scope: which rows of a bucket describe one product, at the strictest of three levels that has two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CORE = ["brand", "model", "sku", "condition", "region_variant", "storage_or_size", "release_year"]


def resolve(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, core, bundle, warranty): of each bucket with a group of two rows, the group that counts.

    Level 0 compares all identity fields, region and currency; level 1 leaves out the bundle flag,
    level 2 the warranty too. The first level whose largest group has two rows wins; of equal
    groups, the one seen first (smallest idx). One aggregation over the rows; the levels follow
    from its groups.
    """
    core = F.struct(*[F.col(f"pil.{f}").alias(f) for f in _CORE], "region", "currency").alias("core")
    rows = obs.select(*keys, "idx", core, F.col("pil.bundle_flag").alias("bundle"), F.col("pil.warranty_type").alias("warranty"))
    groups = rows.groupBy(*keys, "core", "bundle", "warranty").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    levels = [
        F.struct(F.lit(0).alias("level"), F.col("bundle").alias("b"), F.col("warranty").alias("w")),
        F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("b"), F.col("warranty").alias("w")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("w")),
    ]
    by_level = groups.withColumn("l", F.explode(F.array(*levels))).groupBy(*keys, "core", "l").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = F.struct((-F.col("l.level")).alias("level"), F.col("n").alias("n"), (-F.col("first")).alias("first"))
    pick = by_level.where("n >= 2").groupBy(*keys).agg(F.max_by(F.struct("l", "core"), best).alias("g"))
    return pick.select(*keys, F.col("g.l.level").alias("level"), F.col("g.core").alias("core"), F.col("g.l.b").alias("bundle"), F.col("g.l.w").alias("warranty"))


def select(obs: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each bucket's group, with identity_scope_level."""
    s = scope.withColumnsRenamed({"core": "_core", "bundle": "_bundle", "warranty": "_warranty"})
    core = F.struct(*[F.col(f"pil.{f}").alias(f) for f in _CORE], "region", "currency")
    same = (core == F.col("_core")) & ((F.col("level") >= 1) | (F.col("pil.bundle_flag") == F.col("_bundle"))) & ((F.col("level") >= 2) | (F.col("pil.warranty_type") == F.col("_warranty")))
    return obs.join(s, keys).where(same).drop("_core", "_bundle", "_warranty").withColumnRenamed("level", "identity_scope_level")

"""The evaluation: one record for each bucket of observations, as one composition of operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import round6
from tidemark.operators import boundary, robust, scope, similarity, weights
from tidemark.profiles import BASE, COLLAPSE_LOSS, CONSTANTS_VERSION, PROTOCOL_VERSION, Profile
from tidemark.schema import RESULT
from tidemark.shared import Scratch


class Evaluation:
    """The steps of an evaluation by name; each is a DataFrame that is planned when it is asked for.

    observations: the columns of keys, idx (order of arrival, unique within a bucket), domain_id,
    merchant_id, price, currency, timestamp, region and pil, all of accepted rows.
    now: epoch seconds, or a column of the observations, the same for all rows of a bucket.
    buckets: rows with the keys of all buckets that get a record, if some may have no accepted row.
    """

    def __init__(self, observations: DataFrame, keys: list[str], now: int | Column, profile: Profile = BASE, scratch: Scratch | None = None, buckets: DataFrame | None = None):
        self.buckets = buckets
        self.observations, self.keys, self.now, self.profile = observations, keys, now, profile
        self.scratch = scratch or Scratch(observations.sparkSession)

    @cached_property
    def scopes(self) -> DataFrame:
        return self.scratch.stage(scope.resolve(self.observations, self.keys))

    @cached_property
    def scoped(self) -> DataFrame:
        return scope.select(self.observations, self.scopes, self.keys)

    @cached_property
    def timed(self) -> DataFrame:
        return weights.temporal(self.scoped, self.now, self.profile)

    @cached_property
    def window_counts(self) -> DataFrame:
        return weights.window_counts(self.timed, self.keys)

    @cached_property
    def bursts(self) -> DataFrame:
        return self.scratch.stage(weights.bursts(self.window_counts, self.keys, self.profile))

    @cached_property
    def raw(self) -> DataFrame:
        rows = weights.raw_weights(self.timed, self.bursts, self.keys)
        return self.scratch.stage(rows.select(*self.keys, "idx", "domain_id", "merchant_id", "price", "age", "W_time", "W_burst", "W_raw"))

    @cached_property
    def first_shares(self) -> DataFrame:
        return self.scratch.stage(weights.shares(self.raw, self.keys, self.profile))

    @cached_property
    def first_weights(self) -> DataFrame:
        return weights.weighted(self.raw, self.first_shares, self.keys)

    @cached_property
    def first_median(self) -> DataFrame:
        return self.scratch.stage(robust.weighted_median(self.first_weights, self.keys))

    @cached_property
    def vectors(self) -> DataFrame:
        return similarity.features(self.raw, self.first_median, self.keys, self.profile)

    @cached_property
    def clusters(self) -> DataFrame:
        return similarity.clusters(self.vectors, self.keys, self.profile.similarity, self.scratch)

    @cached_property
    def discounted(self) -> DataFrame:
        return self.scratch.stage(similarity.discount(self.raw, self.clusters, self.keys))

    @cached_property
    def cluster_loss(self) -> DataFrame:
        return similarity.loss(self.discounted, self.keys)

    @cached_property
    def second_shares(self) -> DataFrame:
        return self.scratch.stage(weights.shares(self.discounted, self.keys, self.profile))

    @cached_property
    def second_median(self) -> DataFrame:
        return self.scratch.stage(robust.weighted_median(weights.weighted(self.discounted, self.second_shares, self.keys), self.keys))

    @cached_property
    def inliers(self) -> DataFrame:
        return self.scratch.stage(robust.inliers(self.discounted, self.second_median, self.keys, self.profile))

    @cached_property
    def final_shares(self) -> DataFrame:
        return self.scratch.stage(weights.shares(self.inliers, self.keys, self.profile))

    @cached_property
    def final_weights(self) -> DataFrame:
        return weights.weighted(self.inliers, self.final_shares, self.keys)

    @cached_property
    def final_median(self) -> DataFrame:
        return self.scratch.stage(robust.weighted_median(self.final_weights, self.keys))

    @cached_property
    def mad(self) -> DataFrame:
        return robust.deviations(self.inliers, self.final_median, self.keys, "mad")

    @cached_property
    def effective(self) -> DataFrame:
        return robust.effective(self.final_weights, self.final_shares, self.keys)

    def _any_over(self) -> DataFrame:
        out = None
        for share in (self.first_shares, self.second_shares, self.final_shares):
            part = share.groupBy(*self.keys).agg(F.bool_or("over").alias("over"))
            out = part if out is None else out.unionByName(part)
        return out.groupBy(*self.keys).agg(F.bool_or("over").alias("dominant"))

    @cached_property
    def result(self) -> DataFrame:
        """(keys, the columns of RESULT, display_text, cluster_loss): a record for every bucket that has observations.

        Buckets without two rows of one identity, without rows of a valid age, or without weight
        are cold: they have no prices, and no effective sample unless it fell short at the gate.
        """
        k, p = self.keys, self.profile
        out = (self.observations if self.buckets is None else self.buckets).select(*k).distinct()
        burst = self.bursts.groupBy(*k).agg(F.bool_or(F.col("W_burst") < 1).alias("burst"))
        center = self.final_median.withColumnRenamed("median", "price")
        for part in (self.scopes.select(*k, "level"), burst, self._any_over(), self.cluster_loss, center, self.mad, self.effective):
            out = out.join(part, k, "left")
        n_eff = F.coalesce("n_eff", F.lit(0.0))
        cold = F.col("price").isNull() | robust.is_cold(F.coalesce("weight", F.lit(0.0)), n_eff, p)
        out = out.withColumns({"cold": cold, "N": n_eff})
        cs = F.when(F.col("cold"), 0.0).otherwise(robust.confidence(F.col("N"), F.col("weight"), F.col("top_share"), p))
        out = out.withColumns({"cs": cs, "lost": F.coalesce("cluster_loss", F.lit(0.0))})
        status = (
            F.when(F.col("cold"), "COLD_START")
            .when(F.coalesce("burst", F.lit(False)), "BURST_DETECTED")
            .when(F.coalesce("dominant", F.lit(False)), "DOMAIN_DOMINANCE")
            .when(F.col("lost") > COLLAPSE_LOSS, "CLUSTER_COLLAPSE")
            .otherwise("NORMAL")
        )
        price, mad = F.when(~F.col("cold"), round6(F.col("price"))), F.when(~F.col("cold"), round6(F.col("mad")))
        display = F.when(F.col("cold") | (F.col("cs") < p.display_confidence), "Low Confidence").otherwise(F.concat(F.lit("Market Reference Price = "), price.cast("string")))
        columns = [
            F.lit(p.name), F.lit(PROTOCOL_VERSION), F.lit(CONSTANTS_VERSION), F.col("level"), price, mad, round6(F.col("cs")), round6(F.col("N")),
            F.col("cold"), F.col("cold"), status,
        ]
        return out.select(*k, *[c.alias(n) for c, n in zip(columns, RESULT, strict=True)], display.alias("display_text"), round6(F.col("lost")).alias("cluster_loss"))


def evaluate(observations: DataFrame, keys: list[str], now: int | Column, profile: Profile = BASE, buckets: DataFrame | None = None) -> DataFrame:
    """(keys, the columns of RESULT), cut off from the intermediate tables."""
    with Scratch(observations.sparkSession) as scratch:
        return scratch.finish(Evaluation(observations, keys, now, profile, scratch, buckets).result.select(*keys, *RESULT))


def respond(raw: DataFrame, rules: DataFrame, keys: list[str], now: int | Column, profile: Profile, buckets: DataFrame) -> DataFrame:
    """(keys, response) of every bucket: counts of accepted and refused raw observations, reasons, and the record under `result`."""
    judged = boundary.judge(raw, rules, now)
    records = evaluate(boundary.accepted(judged), keys, now, profile, buckets)
    out = buckets.select(*keys).distinct().join(boundary.summary(judged, *keys), keys, "left").join(records, keys)
    none = F.expr("CAST(map() AS map<string,bigint>)")
    response = F.struct(
        F.lit("ok").alias("status"), "protocol_version", "constants_version", "applied_profile",
        F.coalesce("accepted_count", F.lit(0)).alias("accepted_count"), F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"),
        F.coalesce("rejection_reasons_summary", none).alias("rejection_reasons_summary"), F.struct(*RESULT).alias("result"),
    )
    return out.select(*keys, response.alias("response"))

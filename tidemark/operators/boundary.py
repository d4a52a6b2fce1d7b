"""The input boundary: raw observations to normalized ones, or a reason for each that is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.domains import url_roots
from tidemark.schema import PIL_FIELDS

#: In the order in which they are checked.
REASONS = ["invalid_price", "missing_currency", "missing_region", "invalid_domain", "invalid_merchant_id", "invalid_timestamp", "missing_pil"]
#: A reason that records may name, for faults that no check tells apart; none is left here, as rows are judged column by column.
OTHER_REASON = "normalization_error"


def judge(raw: DataFrame, rules: DataFrame, now: int | Column) -> DataFrame:
    """raw (the columns of RAW_OBSERVATION and any others) -> normalized columns and `reason`, null where accepted.

    A URL without a host falls back to the row's domain_id, normalized but not cut to its root.
    """
    rows = url_roots(raw.withColumnRenamed("domain_id", "_domain_id"), rules)
    pil = F.col("product_identity_layer")
    known = set(RAW_NAMES) | {"_domain_id", "host", "root_domain"}
    others = [c for c in raw.columns if c not in known]
    domain = F.when(F.col("host").isNotNull(), F.col("root_domain")).when(F.col("_domain_id").isNotNull(), S.normalize_string(F.col("_domain_id")))
    out = rows.select(
        *others,
        domain.alias("domain_id"),
        S.canonical_merchant(F.col("merchant_id")).alias("merchant_id"),
        S.valid_price(F.col("price")).alias("price"),
        S.normalize_string(F.col("currency")).alias("currency"),
        S.canonical_timestamp(F.col("timestamp"), now).alias("timestamp"),
        S.normalize_string(F.col("region")).alias("region"),
        F.when(pil.isNotNull(), F.struct(*[S.normalize_string(pil[f]).alias(f) for f in PIL_FIELDS])).alias("pil"),
        "source_url",
    )
    checks = [F.col("price").isNull(), F.col("currency") == "", F.col("region") == "", F.col("domain_id").isNull(), F.col("merchant_id").isNull(), F.col("timestamp").isNull(), F.col("pil").isNull()]
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in zip(checks, REASONS, strict=True)])
    return out.withColumn("reason", reason)


RAW_NAMES = ["source_url", "domain_id", "merchant_id", "price", "currency", "region", "timestamp", "product_identity_layer"]


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").drop("reason").withColumn("evidence_hash", S.evidence_hash())


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL")


def summary(judged: DataFrame, *keys: str) -> DataFrame:
    """(keys, accepted_count, rejected_count, rejection_reasons_summary map<reason, count>), the counts pre-aggregated."""
    counts = judged.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    n = F.col("n")
    return counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("reason").isNull(), n).otherwise(0)).alias("accepted_count"),
        F.sum(F.when(F.col("reason").isNotNull(), n).otherwise(0)).alias("rejected_count"),
        F.map_from_entries(entries).alias("rejection_reasons_summary"),
    )

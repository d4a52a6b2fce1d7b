"""One request at a time: a batch of a running program in, its response out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.evaluation import respond
from tidemark.profiles import get_profile
from tidemark.sources.json_io import raw_observations


def evaluate_request(spark: SparkSession, request: dict, rules: DataFrame) -> dict:
    """request (observations, current_time_utc, applied_profile) -> status, versions, counts, reasons and the record; ValueError for an unknown profile."""
    profile = get_profile(request.get("applied_profile") or "BASE")
    raw = raw_observations(spark, request["observations"], "request")
    bucket = spark.range(1).select(F.lit("request").alias("batch"))
    return respond(raw, rules, ["batch"], int(request["current_time_utc"]), profile, bucket).first()["response"].asDict(recursive=True)

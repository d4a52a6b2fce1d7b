"""Schemas of observations, batches, jobs and results."""

from __future__ import annotations

from pyspark.sql import types as T

PIL_FIELDS = ["brand", "model", "sku", "condition", "bundle_flag", "warranty_type", "region_variant", "storage_or_size", "release_year"]
PIL = T.StructType([T.StructField(f, T.StringType()) for f in PIL_FIELDS])

#: Leaves are strings: a raw token is only judged by the boundary, never by the reader.
RAW_OBSERVATION = T.StructType(
    [T.StructField(f, T.StringType()) for f in ("source_url", "domain_id", "merchant_id", "price", "currency", "region", "timestamp")]
    + [T.StructField("product_identity_layer", PIL)]
)
BATCH = T.StructType([T.StructField("description", T.StringType()), T.StructField("observations", T.ArrayType(RAW_OBSERVATION))])
JOB = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("observations", T.ArrayType(RAW_OBSERVATION)),
                    T.StructField("current_time_utc", T.LongType()),
                    T.StructField("applied_profile", T.StringType()),
                    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
                ]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)
#: Columns of an evaluation record, in their order.
RESULT = [
    "applied_profile", "protocol_version", "constants_version", "identity_scope_level", "P_ref", "MAD", "CS", "N_eff",
    "cold_start_flag", "insufficient_data_flag", "integrity_status",
]

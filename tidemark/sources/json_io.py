"""JSON batches and records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import BATCH, RAW_OBSERVATION, RESULT
from tidemark.shared import Scratch, small
from tidemark.sources import pieces


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Raw observations of JSON batch files, one document a file: batch (the file), idx (place in it) and the raw columns.

    Large files are read element by element, and staged until the session's driver ends.
    """
    docs = spark.read.schema(BATCH).option("multiLine", True).json(path).where(F.col("_metadata.file_size") <= pieces.LARGE)
    rows = docs.select(F.col("_metadata.file_path").alias("batch"), F.posexplode("observations").alias("idx", "o"))
    rows = rows.select("batch", F.col("idx").cast("long").alias("idx"), "o.*")
    if not pieces.large(spark, path):
        return rows
    scratch = Scratch(spark)
    unread = F.from_json("json", "_corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull() & (F.col("json") != "null")
    found = pieces.elements(pieces.parts(spark, path), ("observations",))
    found = found.select(F.col("file").alias("batch"), "idx", ((F.col("idx") == pieces.BROKEN) | unread).alias("unread"), F.when((F.col("idx") >= 0) & ~unread, F.col("json")).alias("json"))
    # as files, their tokens are read as they stand, like those of whole documents; no JSON text holds the separator
    at = F.to_json(F.struct("batch", "idx", "unread"))
    line = F.concat(F.substr(at, F.lit(1), F.length(at) - 1), F.lit(',"o":'), F.coalesce("json", F.lit("null")), F.lit("}"))
    found.select(line.alias("value")).write.option("lineSep", "\x01").text(f"{scratch.path}/elements")
    schema = f"batch string, idx bigint, unread boolean, o {RAW_OBSERVATION.simpleString()}"
    found = spark.read.schema(schema).option("lineSep", "\x01").json(f"{scratch.path}/elements")
    found = found.join(small(found.where("unread").select("batch").distinct()), "batch", "left_anti").where("idx >= 0")
    return rows.unionByName(scratch.later(found.select("batch", "idx", "o.*")))


def batch_names(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of all batch files, those without observations too."""
    return spark.read.schema(BATCH).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("batch")).distinct()


def raw_observations(spark: SparkSession, observations: list[dict], batch: str = "batch") -> DataFrame:
    """Observations of a running program, their values as their JSON text would have them."""
    lines = [json.dumps({"batch": batch, "idx": i, "o": o}) for i, o in enumerate(observations)]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    parsed = F.from_json("line", f"batch string, idx bigint, o {RAW_OBSERVATION.simpleString()}")
    return rows.select(parsed.alias("r")).select("r.batch", "r.idx", "r.o.*")


def record_json(result: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): each record as one line, its keys in their order, nulls kept."""
    return result.select(*keys, F.to_json(F.struct(*RESULT), {"ignoreNullFields": "false"}).alias("json"))


def pretty(row) -> str:
    """A record as the indented text that is printed for one batch."""
    return json.dumps({k: row[k] for k in RESULT}, indent=2, ensure_ascii=False)

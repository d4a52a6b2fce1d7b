"""Hash manifests and differences of nested settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files that a path or pattern names."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_hashes(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, sha256) of rows: columns as text, joined by a unit separator, null as empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.select(key, F.sha2(text, 256).alias("sha256"))


def compare(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of all keys of either side: PASS, MISMATCH, MISSING_ACTUAL or MISSING_EXPECTED."""
    e = expected.select(F.col(key).alias("_e_key"), F.col(value).alias("_e"))
    a = actual.select(F.col(key).alias("_a_key"), F.col(value).alias("_a"))
    both = e.join(a, e["_e_key"] == a["_a_key"], "full_outer")
    status = (
        F.when(F.col("_a_key").isNull(), "MISSING_ACTUAL")
        .when(F.col("_e_key").isNull(), "MISSING_EXPECTED")
        .when(F.col("_e").eqNullSafe(F.col("_a")), "PASS")
        .otherwise("MISMATCH")
    )
    return both.select(F.coalesce("_e_key", "_a_key").alias(key), status.alias("status"))


def report(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def flatten_json(rows: DataFrame, text: str = "json") -> DataFrame:
    """(key, value) of a JSON object's leaves, keys joined by dots, at any depth; lists and empty objects are leaves and stay JSON."""
    leaf = "STRUCT<key: STRING, value: VARIANT>"
    level = rows.select(F.lit("").alias("up"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        # one level a round, as many as the documents are deep
        inner = level.select("up", F.explode(F.expr(f"CAST(map_entries(TRY_CAST(v AS MAP<STRING, VARIANT>)) AS ARRAY<{leaf}>)")).alias("e"))
        inner = inner.select(F.concat("up", F.when(F.col("up") == "", "").otherwise("."), F.col("e.key")).alias("key"), F.col("e.value").alias("v"))
        nested = F.coalesce(F.expr("schema_of_variant(v) LIKE 'OBJECT<_%>'"), F.lit(False))
        flat = inner.where(~nested).select("key", F.expr("CASE WHEN schema_of_variant(v) = 'VOID' THEN NULL ELSE to_json(v) END").alias("value"))
        flat = flat.withColumn("value", F.regexp_replace("value", r'^"(.*)"$', "$1"))
        found = flat if found is None else found.unionByName(flat)
        level = inner.where(nested).select(F.col("key").alias("up"), "v")
        if not level.limit(1).count():
            return found


def versions(texts: DataFrame, text: str = "text") -> DataFrame:
    """(version, kind, n) found in texts: semantic versions, two-part document versions, dated snapshots."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b(?:PSL-\d{4}-\d{2}-\d{2}|v?\d+\.\d+(?:\.\d+)?)\b"), F.lit(0))).alias("found"))
    kind = F.when(F.col("found").startswith("PSL-"), "snapshot").when(F.col("found").rlike(r"^v?\d+\.\d+\.\d+$"), "semantic").otherwise("document")
    return found.select(F.regexp_replace("found", "^v", "").alias("version"), kind.alias("kind")).groupBy("version", "kind").agg(F.count(F.lit(1)).alias("n"))


def version_consistency(found: DataFrame) -> DataFrame:
    """versions() -> one row (semver_consistent, doc_to_semver_mapping_valid, is_consistent): one semantic version at most, and one for each document version X.Y, as X.Y.Z."""
    semantic = found.where("kind = 'semantic'").select("version").distinct()
    documents = found.where("kind = 'document'").select("version").distinct()
    unmapped = documents.join(semantic.select(F.regexp_extract("version", r"^(\d+\.\d+)\.", 1).alias("version")).distinct(), "version", "left_anti")
    flags = semantic.select(F.lit(1).alias("semantic"), F.lit(0).alias("unmapped")).union(unmapped.select(F.lit(0), F.lit(1)))
    out = flags.agg((F.coalesce(F.sum("semantic"), F.lit(0)) <= 1).alias("semver_consistent"), (F.coalesce(F.sum("unmapped"), F.lit(0)) == 0).alias("doc_to_semver_mapping_valid"))
    return out.withColumn("is_consistent", F.col("semver_consistent") & F.col("doc_to_semver_mapping_valid"))


def manifest(files: DataFrame, root: str) -> DataFrame:
    """file_hashes() -> (file, sha256) with names relative to a root folder."""
    return files.select(F.regexp_replace(F.substring_index("path", f"{root.rstrip('/')}/", -1), "^/", "").alias("file"), "sha256")


def check_presence(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(check, status) of each required name: PASS if it is present, FAIL if not."""
    seen = present.select(F.col(key).alias("_key")).distinct().withColumn("_seen", F.lit(True))
    out = required.join(seen, required[key] == seen["_key"], "left")
    return out.select(F.concat(F.lit("present:"), F.col(key)).alias("check"), F.when(F.col("_seen"), "PASS").otherwise("FAIL").alias("status"))


def check_hashes(registered: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, status) of each registered (file, sha256): PASS if the file has that hash, FAIL if another one or none."""
    status = F.when(F.col("status") == "PASS", "PASS").otherwise("FAIL").alias("status")
    rows = compare(registered, actual, "file", "sha256").where("status <> 'MISSING_EXPECTED'")
    return rows.select(F.concat(F.lit("hash:"), F.col("file")).alias("check"), status)


def check_fields(registry: DataFrame, fields: list[str], text: str = "json") -> DataFrame:
    """(check, status) of the top-level fields that a registry document must have."""
    names = F.coalesce(F.json_object_keys(text), F.array())
    return registry.select(F.explode(F.array(*[F.struct(F.lit(f"field:{f}").alias("check"), F.when(F.array_contains(names, f), "PASS").otherwise("FAIL").alias("status")) for f in fields])).alias("c")).select("c.*")


def check_versions(code: DataFrame, documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(check, status) of version texts: code versions (name, version) are one semantic version; documents' X.Y map to it, else WARN; snapshots are named PSL- and a date, else WARN."""
    seen = code.agg(F.count_distinct("version").alias("n"), F.bool_and(F.col("version").rlike(r"^\d+\.\d+\.\d+$")).alias("ok"))
    one = seen.select(F.lit("versions:code").alias("check"), F.when((F.col("n") == 1) & F.col("ok"), "PASS").otherwise("FAIL").alias("status"))
    known = code.select(F.regexp_extract("version", r"^(\d+\.\d+)\.", 1).alias("version")).distinct().withColumn("_known", F.lit(True))
    mapped = documents.join(known, "version", "left").select(
        F.concat(F.lit("versions:document:"), F.col("name")).alias("check"), F.when(F.col("_known"), "PASS").otherwise("WARN").alias("status")
    )
    dated = snapshots.select(F.concat(F.lit("versions:snapshot:"), F.col("name")).alias("check"), F.when(F.col("version").rlike(r"^PSL-\d{4}-\d{2}-\d{2}$"), "PASS").otherwise("WARN").alias("status"))
    return one.unionByName(mapped).unionByName(dated)

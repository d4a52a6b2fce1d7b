"""Registrable domains of hosts, by public-suffix rules."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import extract_host
from tidemark.shared import small

#: Used where no rule file is given: the pinned list PSL-2026-01-01; another file is a parameter.
RULE_FILE = "public_suffixes.dat"


def _parse(lines: DataFrame) -> DataFrame:
    line = F.lower(F.trim(F.regexp_replace("value", "\r$", "")))
    rows = lines.select(line.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')")
    kind = F.when(F.col("rule").startswith("!"), "exception").otherwise("rule")
    return rows.select(F.regexp_replace("rule", "^!", "").alias("rule"), kind.alias("kind")).distinct()


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, kind) of a rule file: one a line, // comments, ! exceptions, *. wildcards."""
    return _parse(spark.read.text(path))


def common_rules(spark: SparkSession) -> DataFrame:
    """The rules of the package's own file, read by the driver: executors may not have its folder."""
    lines = files("tidemark.functions").joinpath(RULE_FILE).read_text("utf-8").splitlines()
    return _parse(spark.createDataFrame([(x,) for x in lines], "value string"))


def root_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """hosts (host, ...) -> the same rows with root_domain.

    The longest matching rule by labels counts, exceptions first and one label shorter; without a
    rule the last label is the suffix. A host that is a suffix itself, or has one label, is its own
    root. Matching runs on distinct hosts; the rules, some thousands, are broadcast after they were counted.
    """
    labels = F.split(F.col(host), "\\.")
    one = hosts.select(host).where(F.col(host).isNotNull()).distinct().withColumn("_labels", labels)
    k = F.explode(F.sequence(F.lit(1), F.size("_labels")))
    tails = one.select(host, "_labels", k.alias("_k")).withColumn("_tail", F.slice("_labels", -F.col("_k"), F.col("_k")))
    plain = F.array_join("_tail", ".")
    wild = F.concat(F.lit("*."), F.array_join(F.slice("_tail", F.lit(2), F.col("_k") - 1), "."))
    probes = tails.select(host, "_labels", "_k", F.explode(F.array(plain, F.when(F.col("_k") > 1, wild))).alias("rule"))
    matched = probes.join(small(rules), "rule")
    longest = matched.groupBy(host).agg(
        F.max(F.when(F.col("kind") == "exception", F.col("_k") - 1)).alias("_exception"), F.max(F.when(F.col("kind") == "rule", F.col("_k"))).alias("_rule")
    )
    suffix = F.coalesce("_exception", "_rule", F.lit(1))
    root = F.array_join(F.slice("_labels", -F.least(suffix + 1, F.size("_labels")), F.least(suffix + 1, F.size("_labels"))), ".")
    known = one.join(longest, host, "left").select(F.col(host).alias("_host"), root.alias("root_domain"))
    return hosts.join(known, hosts[host] == known["_host"], "left").drop("_host")


def url_roots(rows: DataFrame, rules: DataFrame, url: str = "source_url") -> DataFrame:
    """rows -> the same rows with host and root_domain of their URL; null where it has no host."""
    return root_domains(rows.withColumn("host", extract_host(F.col(url))), rules)

"""Line dedup over levelled sorted runs of line hashes.

Lines arrive in batches, largest doc_ids first. A batch is aggregated to one row a key, merge-anti-joined
with the runs that exist (keys not found there are fresh: their largest holder is in this batch), and
written as a sorted run of level 0. FANOUT runs of one level are merged into one run of the next.
What remains after the last batch is merged to (key, documents, largest holder).

Runs are tables bucketed and sorted by key, one file a bucket, so that joins and merges read them as they lie:
only a batch is shuffled and sorted, once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small, table

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 3
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


#: Lets scans of bucketed tables say that a bucket's one file is sorted.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Runs:
    """The levelled runs: rows (h1, h2, docs, holder), each a table bucketed and sorted by (h1, h2)."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout, self.levels = scratch, fanout, []
        self.spark = scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    @contextmanager
    def sorted_scans(self) -> Iterator[None]:
        """In here, joins and merges of runs are planned without sorting them; at the end the tables' names go."""
        before = self.spark.conf.get(_SORTED_SCANS, None)
        self.spark.conf.set(_SORTED_SCANS, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_SORTED_SCANS)
            else:
                self.spark.conf.set(_SORTED_SCANS, before)
            for name in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _table(self, rows: DataFrame) -> DataFrame:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def _write(self, level: int, rows: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._table(rows))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(level + 1, self._merged(runs))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Two runs merge by a full outer join of their buckets; of more, the first two become one run, and so on."""
        out, *rest = runs
        for i, r in enumerate(rest):
            out = self._table(out) if i else out
            r = r.toDF(*[f"r_{c}" for c in r.columns])
            both = out.hint("merge").join(r, (out["h1"] == r["r_h1"]) & (out["h2"] == r["r_h2"]), "full_outer")
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("r_docs", F.lit(0))
            out = both.select(F.coalesce("h1", "r_h1").alias("h1"), F.coalesce("h2", "r_h2").alias("h2"), docs.alias("docs"), F.greatest("holder", "r_holder").alias("holder"))
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, doc_id), each pair of key and document once, its doc_ids below those added before."""
        mine = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder"))
        known = F.lit(False)
        for i, run in enumerate(r for runs in self.levels for r in runs):
            mine = mine.join(run.select("h1", "h2", F.lit(True).alias(f"in{i}")).hint("merge"), ["h1", "h2"], "left")
            known = known | F.col(f"in{i}").isNotNull()
        # only the batch that saw a key first names its holder: what no run has
        self._write(0, mine.select("h1", "h2", "docs", F.when(~known, F.col("holder")).alias("holder")))

    def totals(self) -> DataFrame:
        return self._merged([r for runs in self.levels for r in runs])


def dedup_lines(
    docs: DataFrame, scratch: Scratch, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """docs (doc_id, text, any more columns) -> the same rows with columns kept_text, n_lines and n_dropped.

    A line whose key (white space stripped, A-Z lowered) has min_chars code points or more and is
    held by min_docs documents or more stays only in the largest doc_id that holds it, there at
    each place. Null and empty texts are one empty line. Rows that share a doc_id are one document
    for the counts; rows without a doc_id count for nothing and lose nothing. Keys are compared
    by 128-bit hashes. No rows give no rows. Time is linear in a text's lines, however many are lost.
    """
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(lines_of(F.col("text"))).alias("line"))
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("doc_id", *_hashes(F.col("key")))
    keys = scratch.stage(keys.distinct())
    cuts = keys.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    runs = Runs(scratch, fanout)
    with runs.sorted_scans():
        for lo, hi in reversed(list(zip(bounds, bounds[1:], strict=False))):
            batch = keys
            batch = batch.where(F.col("doc_id") > lo) if lo is not None else batch
            batch = batch.where(F.col("doc_id") <= hi) if hi is not None else batch
            runs.add(batch)
        common = scratch.stage(runs.totals().where(F.col("docs") >= min_docs).select("h1", "h2", "holder"))
    # places of lost lines, by document and text
    places = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    places = places.select("doc_id", "row", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("doc_id", "row", "at", *_hashes(F.col("key")))
    places = places.join(small(common), ["h1", "h2"]).where("doc_id < holder")
    lost = scratch.stage(places.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("_lost"))).withColumnsRenamed({"doc_id": "_doc_id", "row": "_row"})
    own = docs.withColumns({"_lines": lines_of(F.col("text")), "_text": F.xxhash64("text")})
    out = own.join(lost, (own["doc_id"] == lost["_doc_id"]) & (own["_text"] == lost["_row"]), "left").drop("_doc_id", "_row", "_text")
    # what lies between lost lines stays
    out = out.withColumn("_cuts", F.concat(F.array(F.lit(-1)), F.coalesce("_lost", F.expr("CAST(array() AS array<int>)")), F.array(F.size("_lines"))))
    between = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.slice("_lines", F.get("_cuts", i) + 2, F.get("_cuts", i + 1) - F.get("_cuts", i) - 1))
    kept = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.flatten(between))
    return out.select(
        *[own[c] for c in docs.columns],
        F.array_join(kept, "\n").alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), scratch)
        return scratch.finish(out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.*, c.holder IS NOT NULL AND k.doc_id < c.holder AS lost FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

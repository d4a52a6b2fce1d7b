"""Benchmark decontamination in DataFrame expressions only.

A document holds an item if an item-sized window of it has a weighted Jaccard similarity of MIN_SIMILARITY
(NUM / DEN) or more with the item, on shingles of SHINGLE words that weigh as often as they occur.

Why windows are not found by blocks of SimHash fingerprints: at a similarity of 0.8 two fingerprints differ
in about 15 % of their bits, so that a radius that loses nothing worth naming takes blocks of three bits,
which single out nothing; a radius with selective blocks loses links (figures in the README). The index here is
over the shingles themselves, and its pigeonhole argument holds for any texts:

Anchors: of an item's n shingles, a similar window shares NUM / DEN * n or more (see _anchors). Whichever shingles
of a total weight above n - that are chosen, it holds one of them. The rarest in the documents are the item's anchors.
Counts: only documents with an anchor of an item are compared with it. Sorted by place, the shingles there that are the item's
tell for each whether enough of them follow within an item-sized window.
Then such a window's weighted similarity is computed exactly. One pass reads the texts; all else are light rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small, table

SHINGLE, NUM, DEN = 5, 80, 100
#: Shingles of all items up to which they may be broadcast, after they were counted (a long each).
INDEX_ROWS = 1_000_000
_DOC, _ITEM = ["doc_id", "row"], ["item_id", "version"]


def words_of(text: Column) -> Column:
    """A whole text's words; lower case, words by ASCII white space; null and wordless texts have none."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    for c in "\t\n\x0b\f\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " ", -1), "")


def _shingles(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """rows (keep, w) -> keep, words, at, key: a row for each place and each of the sizes, with the hash of so many words from there."""

    def starts(size: int) -> Column:
        last = F.size("w") - size
        at = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.lit(size).alias("size"), i.alias("at")))
        return F.when(last >= 0, at).otherwise(F.expr("CAST(array() AS array<struct<size:int,at:int>>)"))

    def hash_of(size: int) -> Column:
        return F.xxhash64(F.lit(size), *[F.get("w", F.col("at") + i) for i in range(size)])

    if len(sizes) == 1:
        last = F.size("w") - sizes[0]
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        return rows.select(*keep, "w", F.explode(at).alias("at")).select(*keep, F.size("w").alias("words"), "at", hash_of(sizes[0]).alias("key"))
    key = F.lit(None).cast("long")
    for size in sizes:
        key = F.when(F.col("size") == size, hash_of(size)).otherwise(key)
    return rows.select(*keep, "w", F.inline(F.concat(*[starts(s) for s in sizes]))).select(*keep, F.size("w").alias("words"), "at", key.alias("key"))


def _index(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(item_id, version, length, n, key, weight): an item's words, its shingles, and how often each occurs. Texts of one item_id are versions."""
    found = None
    for size in sizes:
        own = items.where(F.size("w") >= size if size == SHINGLE else F.size("w") == size)
        part = _shingles(own, _ITEM, [size])
        found = part if found is None else found.unionByName(part)
    rows = found.groupBy(*_ITEM, F.col("words").alias("length"), "key").agg(F.count(F.lit(1)).alias("weight"))
    return rows.withColumn("n", F.sum("weight").over(Window.partitionBy(*_ITEM)))


def _least_shared(n: Column, m: Column) -> Column:
    """Shingles that bags of n and m share at least where their similarity is enough."""
    return F.ceil((n + m) * NUM / (NUM + DEN)).cast("long")


def _anchors(index: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, version, key): shingles of each item of which any similar window holds one.

    A window has as many shingles as the item or, where a document is shorter than the item, m fewer than n of
    them; it shares s with s >= (n + m) NUM / (NUM + DEN) and s <= m, hence m >= n NUM / DEN and s >= n NUM / DEN.
    Shingles with a total weight above n - s therefore meet the window. The rarest are taken.
    """
    often = hits.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    rows = index.join(often, "key", "left")
    before = Window.partitionBy(*_ITEM).orderBy(F.coalesce("often", F.lit(0)), "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    enough = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    return rows.where((F.col("before") < enough) & F.col("often").isNotNull()).select(*_ITEM, "key")


def find_items(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) and benchmark (item_id, text) -> (doc_id, item_id, similarity) of what documents hold.

    An item is held where a window of as many words has a weighted Jaccard similarity of NUM / DEN
    or more with it, on shingles of SHINGLE words; of shorter items all words must agree in order. A
    document with fewer words than the item is compared whole. Shingles are compared by 64-bit hashes.
    Null and wordless texts and items hold nothing and are held nowhere; rows that share a doc_id
    are one document that holds what one of them holds, items that share an item_id one item; rows without an id are left out.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = scratch.stage(items.withColumn("version", F.xxhash64("w")).dropDuplicates(_ITEM))
    sizes = sorted(r["s"] for r in items.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("s")).distinct().collect())  # five at most
    if not sizes:
        return scratch.spark.createDataFrame([], "doc_id long, item_id long, similarity double")
    index = scratch.stage(_index(items, sizes))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w"))
    hits = _shingles(docs, _DOC, sizes).join(small(index.select("key").distinct(), INDEX_ROWS), "key")
    hits = scratch.stage(hits.select(*_DOC, "words", "at", "key").distinct())  # rows that are repeated count once
    places = hits.select(*_DOC, "key").join(small(_anchors(index, hits)), "key").select(*_DOC, *_ITEM).distinct()
    of_item = [*_DOC, *_ITEM]
    own = hits.join(places, _DOC).join(small(index), [*_ITEM, "key"])
    window = F.least("words", "length")
    m = F.when(F.col("length") >= SHINGLE, window - (SHINGLE - 1)).otherwise(1).cast("int")
    # a window that starts later, at the next shingle of the item or as the last one, shares no less
    own = own.select(*of_item, "at", "key", "weight", "n", m.alias("m"), F.least("at", F.col("words") - window).alias("start"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*of_item).orderBy("at", "key")))
    own = scratch.stage(own)
    last = own.select(*of_item, (F.col("nth") - _least_shared(F.col("n"), F.col("m")) + 1).alias("nth"), F.col("at").alias("last"))
    windows = own.select(*of_item, "nth", "start", "n", "m").join(last, [*of_item, "nth"]).where("last < start + m")
    windows = windows.select(*of_item, "start", "n", "m").distinct()
    # a window meets the shingles of the two stretches of n places in which it lies
    stretch = F.floor(F.col("start") / F.col("n"))
    spread = windows.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    inside = own.select(*of_item, "at", "key", "weight", F.floor(F.col("at") / F.col("n")).alias("stretch"))
    inside = spread.join(inside, [*of_item, "stretch"]).where("at >= start AND at < start + m")
    shared = inside.groupBy(*of_item, "start", "n", "m", "key").agg(F.least(F.count(F.lit(1)), F.first("weight")).alias("shared"))
    sums = shared.groupBy(*of_item, "start", "n", "m").agg(F.sum("shared").alias("shared"))
    sums = sums.select("doc_id", "item_id", "shared", (F.col("n") + F.col("m") - F.col("shared")).alias("all")).where(F.col("shared") * DEN >= F.col("all") * NUM)
    return sums.groupBy("doc_id", "item_id").agg(F.max(F.col("shared") / F.col("all")).alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """docs -> (doc_id, contaminated, item_ids, similarity), one row for each row: sorted items held and the best similarity, null if none."""
    held = scratch.stage(find_items(docs, benchmark, scratch))
    per = held.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.expr("CAST(array() AS array<bigint>)")).alias("item_ids"), "similarity")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    with Scratch(spark) as scratch:
        return scratch.finish(contamination(docs, benchmark, scratch))

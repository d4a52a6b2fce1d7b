"""Clusters of near-identical rows, and what their weight loses.

Rows with the same domain or the same merchant are linked where the cosine of their feature vectors
reaches the threshold. Clusters need the links' components only, so pairs are mostly never made: unit
vectors fall into cells so small that all rows of a domain (or merchant) in one cell are linked; two
cells of a domain are linked, or not, for certain by the boxes around their rows; cell pairs that stay undecided and
are not connected otherwise are cut into smaller cells and decided by their boxes again, until few enough rows are left
to be compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_unit
from tidemark.profiles import Profile
from tidemark.shared import Scratch, components, extended

_X = ["x0", "x1", "x2", "x3"]
#: Comparisons of rows that an undecided pair of cells may take; larger ones are cut, CUTS times at most (a cell's side is then a 64th).
COMPARISONS, CUTS = 1_000_000, 6


def features(rows: DataFrame, center: DataFrame, keys: list[str], p: Profile) -> DataFrame:
    """(keys, idx, domain_id, merchant_id, x0..x3): unit vectors of price, age and the hashes of domain and merchant."""
    out = rows.join(center, keys)
    raw = [F.when(F.col("median") > 0, F.col("price") / F.col("median")).otherwise(0.0), F.col("age") / p.max_age, hash_unit(F.col("domain_id")), hash_unit(F.col("merchant_id"))]
    out = out.select(*keys, "idx", "domain_id", "merchant_id", *[r.alias(f"r{i}") for i, r in enumerate(raw)])
    norm = F.sqrt(sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(1, 4)), F.col("r0") * F.col("r0")))
    out = out.withColumn("norm", norm)
    return out.select(*keys, "idx", "domain_id", "merchant_id", *[F.when(F.col("norm") > 0, F.col(f"r{i}") / F.col("norm")).otherwise(F.col(f"r{i}")).alias(f"x{i}") for i in range(4)])


def _dot(a: str, b: str):
    return sum((F.col(f"{a}.{x}") * F.col(f"{b}.{x}") for x in _X[1:]), F.col(f"{a}.x0") * F.col(f"{b}.x0"))


def pairs(vectors: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, idx_a, idx_b, similarity) of all linked pairs, idx_a < idx_b: a report, quadratic in a domain's rows."""
    out = None
    for key in ("domain_id", "merchant_id"):
        a, b = vectors.where(F.col(key) != "").alias("a"), vectors.where(F.col(key) != "").alias("b")
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, key]]
        found = a.join(b, on).where("a.idx < b.idx").select(*[F.col(f"a.{k}") for k in keys], F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), _dot("a", "b").alias("similarity"))
        found = found.where(F.col("similarity") >= threshold)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates([*keys, "idx_a", "idx_b"])


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rep, rows, lo_x.., hi_x..): a node, the number of rows and the box of each cell."""
    box = [F.min(x).alias(f"lo_{x}") for x in _X] + [F.max(x).alias(f"hi_{x}") for x in _X]
    return points.groupBy(*keys).agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("rows"), *box)


def _decided(two: DataFrame, reach: float, group: list, cell: str = "cell") -> DataFrame:
    """Pairs of cells (a.., b..) whose boxes are within reach, with sure: all of their rows are."""
    zero, limit = F.lit(0.0), reach * reach
    near = sum((F.pow(F.greatest(zero, F.col(f"a.lo_{x}") - F.col(f"b.hi_{x}"), F.col(f"b.lo_{x}") - F.col(f"a.hi_{x}")), 2) for x in _X), zero)
    far = sum((F.pow(F.greatest(F.col(f"a.hi_{x}") - F.col(f"b.lo_{x}"), F.col(f"b.hi_{x}") - F.col(f"a.lo_{x}")), 2) for x in _X), zero)
    ends = [F.col(f"{k}.{c}").alias(n) for k in "ab" for c, n in ((cell, f"cell_{k}"), ("rep", k), ("rows", f"rows_{k}"))]
    return two.where(near <= limit + 1e-9).select(*group, *ends, (far < limit - 1e-9).alias("sure"))


def clusters(vectors: DataFrame, keys: list[str], threshold: float, scratch: Scratch) -> DataFrame:
    """(keys, idx, cluster_id, cluster_size) of all rows; cluster_id is the smallest idx that links reach.

    idx must be unique within a bucket; rows that repeat one are one node.
    """
    reach = (2 - 2 * threshold) ** 0.5  # the longest chord of a link
    side = reach / 2 * (1 - 1e-9)  # the diagonal of a cell in four dimensions is two sides
    # nodes are (bucket, idx) as one hash; the chance that two of a run meet is that of 64 bits
    joined = vectors.withColumn("_bucket", F.xxhash64(*keys)).withColumn("node", F.xxhash64(*keys, "idx"))
    kinds = F.array(F.struct(F.lit("d").alias("kind"), F.col("domain_id").alias("key")), F.struct(F.lit("m").alias("kind"), F.col("merchant_id").alias("key")))
    cell = F.struct(*[F.floor(F.col(x) / side).cast("int").alias(x) for x in _X]).alias("cell")
    points = joined.where(_square() > 0).select("_bucket", "node", *_X, F.inline(kinds)).where("key <> ''").select("_bucket", "kind", "key", cell, "node", *_X)
    points = scratch.stage(points)
    group = ["_bucket", "kind", "key"]
    cells = scratch.stage(_boxes(points, [*group, "cell"]))
    own = points.join(cells.select(*group, "cell", "rep"), [*group, "cell"]).where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    a, b = cells.alias("a"), cells.alias("b")
    two = a.join(b, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]).where("a.cell < b.cell")
    two = scratch.stage(_decided(two, reach, [F.col(f"a.{g}") for g in group]))
    edges = scratch.stage(own.union(two.where("sure").select("a", "b")))
    labels = components(edges, scratch)
    for cut in range(CUTS + 1):
        la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
        open_ = two.where("NOT sure").join(la, "a", "left").join(lb, "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")
        open_ = scratch.stage(open_)
        if not open_.limit(1).count():
            break
        few = F.lit(True) if cut == CUTS else F.col("rows_a") * F.col("rows_b") <= COMPARISONS
        pa, pb = points.withColumnRenamed("cell", "cell_a"), points.withColumnRenamed("cell", "cell_b")
        tested = open_.where(few).select(*group, "cell_a", "cell_b", "la", "lb").join(pa, [*group, "cell_a"])
        tested = tested.join(pb.withColumnsRenamed({x: f"y_{x}" for x in _X}).withColumnRenamed("node", "node_b"), [*group, "cell_b"])
        dot = sum((F.col(x) * F.col(f"y_{x}") for x in _X[1:]), F.col("x0") * F.col("y_x0"))
        more = tested.where(dot >= threshold).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        many = open_.where(~few)
        if not many.limit(1).count():
            labels = extended(labels, more, scratch)
            break
        # smaller cells of what is left, each within its cell
        inner = F.struct(*[F.floor(F.col(x) / (side / 2 ** (cut + 1))).cast("int").alias(x) for x in _X])
        held = many.select(*group, F.col("cell_a").alias("cell")).union(many.select(*group, "cell_b")).distinct()
        finer = scratch.stage(points.join(held, [*group, "cell"]).withColumn("inner", inner))
        boxes = _boxes(finer, [*group, "cell", "inner"])
        sides = [boxes.withColumnsRenamed({"cell": f"cell_{k}"}).alias(k) for k in "ab"]
        pairs_ = many.select(*group, "cell_a", "cell_b").join(sides[0], [*group, "cell_a"]).join(sides[1], [*group, "cell_b"])
        two = scratch.stage(_decided(pairs_, reach, [F.col(g) for g in group], "inner"))
        points = finer.drop("cell").withColumnRenamed("inner", "cell")
        labels = extended(labels, more.union(two.where("sure").select("a", "b")), scratch)
    named = joined.select(*keys, "idx", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.stage(named)
    sizes = named.groupBy("component").agg(F.min("idx").alias("cluster_id"), F.count(F.lit(1)).alias("cluster_size"))
    return named.join(sizes, "component").select(*keys, "idx", "cluster_id", "cluster_size")


def _square():
    return sum((F.col(x) * F.col(x) for x in _X[1:]), F.col("x0") * F.col("x0"))


def discount(rows: DataFrame, cluster: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with W_raw divided by the size of their cluster; W_before keeps what it was."""
    out = rows.join(cluster, [*keys, "idx"])
    return out.withColumn("W_before", F.col("W_raw")).withColumn("W_raw", F.col("W_raw") / F.col("cluster_size"))


def loss(discounted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_loss): the share of weight that clusters lost."""
    before, after = F.sum("W_before"), F.sum("W_raw")
    return discounted.groupBy(*keys).agg(F.when(before > 0, (before - after) / before).otherwise(0.0).alias("cluster_loss"))

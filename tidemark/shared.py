"""Shared folders, staged tables and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most three longs that may be broadcast after they were counted (about 10 MB).
BROADCAST_ROWS = 200_000

#: Hooks that are followed by one staged table of components().
JUMPS = 3

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        folder = known.get()
    if not folder:
        if not _own_dir:
            local = sc.master.startswith("local[") or sc.master == "local"
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='tidemark-')}" if local else f"{warehouse}/_checkpoints")
        folder = _own_dir[0]
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def _at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete(spark, path)


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    An executor can be lost at any time: what was staged is read again from the shared
    folder. finish() cuts the result off with a reliable checkpoint, then deletes the rest.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def stage(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/t{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def later(self, df: DataFrame) -> DataFrame:
        """df, which reads staged tables: they stay until the session's driver ends."""
        atexit.register(_at_end, self.spark, self.path)
        return df

    def finish(self, df: DataFrame) -> DataFrame:
        try:
            return df.checkpoint()
        finally:
            self.drop()

    def drop(self) -> None:
        delete(self.spark, self.path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it was counted to hold at most so many rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): (node, component), component being the smallest node.

    Every round hooks each node to its smallest neighbour, follows the hooks to their roots, each step of which
    makes their chains shorter by a factor of JUMPS + 1, and keeps the edges between different roots, so rounds grow with the
    logarithm of the graph. Only joins and min aggregates on (long, long) rows are used:
    groups of any size are pre-aggregated before the shuffle, and hot join keys can be split.
    """
    e = scratch.stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    if e.limit(1).count() == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        hooks = e.select(F.col("b").alias("node"), F.col("a").alias("up")).union(e.select(F.col("a").alias("node"), F.col("a").alias("up")))
        up = scratch.stage(hooks.groupBy("node").agg(F.min("up").alias("up")))
        while True:
            jumped = up.select("node", "up")
            for i in range(JUMPS):
                r = up.select(F.col("node").alias(f"n{i}"), F.col("up").alias(f"u{i}"))
                jumped = jumped.join(r, F.col("up" if i == 0 else f"u{i - 1}") == F.col(f"n{i}")).drop(f"n{i}")
            jumped = scratch.stage(jumped.select("node", F.col(f"u{JUMPS - 1}").alias("up"), (F.col("up") != F.col(f"u{JUMPS - 1}")).alias("moved")))
            up = jumped.select("node", "up")
            if jumped.where("moved").limit(1).count() == 0:
                break
        if labels is None:
            labels = up
        else:
            r = up.select(F.col("node").alias("r_node"), F.col("up").alias("r_up"))
            labels = scratch.stage(labels.join(r, labels["up"] == r["r_node"], "left").select("node", F.coalesce("r_up", "up").alias("up")))
        ra = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        rb = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        between = e.join(ra, "a").join(rb, "b").where("ra != rb")
        e = scratch.stage(between.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if e.limit(1).count() == 0:
            return labels.select("node", F.col("up").alias("component"))


def extended(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """components() of a graph, given the labels (node, component) of it without some edges (a, b): only these are followed."""
    ra, rb = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    between = edges.select("a", "b").join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(between.where("a <> b"), scratch)
    up = more.toDF("r_node", "r_up")
    old = labels.join(up, labels["component"] == up["r_node"], "left").select("node", F.coalesce("r_up", "component").alias("component"))
    return scratch.stage(old.union(more.join(labels.select("node"), "node", "left_anti").select("node", "component")))

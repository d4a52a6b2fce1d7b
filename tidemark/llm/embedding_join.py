"""Embedding near-duplicates over an inverted multi-index.

The two halves of unit vectors have a codebook each; a pair of codewords is a cell of the product grid,
and every vector stands in its cell. Codebooks grow with the root of the number of vectors, so that a cell holds about
PER_CELL at any size. A vector visits cells in the order of the sum of its two squared
codeword distances (multi-sequence traversal), as many as reach the target recall for pairs right at
the threshold, calibrated on a bounded sample. Visits and members of a cell meet in tiles of bounded
size, where cosines are computed in double precision.

Equal vectors are one node with a count. A linked pair is counted once for each of its two vectors: by
the visit of one to the other's cell, and where only one of them visits, that visit counts for both.
Tiles send a count a vector and a star of links a component, never their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, components, table, trimmed

#: Vectors a cell holds on average; codewords a half at most; vectors of the fitting sample, and for each codeword; share of
#: threshold pairs that traversal must reach; members and visits of a tile (cells above it are cut into blocks that all meet).
PER_CELL, CODEWORDS, SAMPLE, SAMPLE_EACH, TARGET_RECALL, TILE = 64, 2048, 6000, 16, 0.995, 1024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(15):
        own = _distances(x, centers).argmin(axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(axis=0)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0)


def multi_sequence(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """For each row of distances, its first `count` cells (i * right's width + j) in the order of left[i] + right[j].

    A cell of the p-th nearest left and the q-th nearest right codeword comes after (p + 1) (q + 1) - 1 others, so only
    cells with (p + 1) (q + 1) <= count are reached; they are sorted by their sums, equal ones by (p, q).
    """
    count = min(count, left.shape[1] * right.shape[1])
    a, b = np.argsort(left, axis=1, kind="stable")[:, :count], np.argsort(right, axis=1, kind="stable")[:, :count]
    p, q = np.array([(p, q) for p in range(a.shape[1]) for q in range(min(b.shape[1], count // (p + 1)))]).T
    i, j = a[:, p], b[:, q]
    sums = np.take_along_axis(left, i, 1) + np.take_along_axis(right, j, 1)
    first = np.argsort(sums, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(i * right.shape[1] + j, first, 1)


class Index:
    """The two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, min_cosine: float, codewords: int, target: float = TARGET_RECALL, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.left, self.right = _kmeans(sample[:, : self.half], codewords if self.half else 1, rng), _kmeans(sample[:, self.half :], codewords, rng)
        # neighbours right at the threshold, in random directions: the hardest pairs to reach
        x = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
        step = rng.standard_normal(x.shape)
        step -= (step * x).sum(axis=1, keepdims=True) * x
        step /= np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
        y = min_cosine * x + np.sqrt(max(0.0, 1 - min_cosine**2)) * step
        left, right = self._to(x)
        i, j = np.divmod(self.cells(y), len(self.right))
        at = np.arange(len(x))
        own = left[at, i] + right[at, j] + 1e-12
        right.sort(axis=1)
        ranks = [int(np.searchsorted(r, s - row, "right").sum()) for row, r, s in zip(left, right, own, strict=True)]
        self.count = max(1, int(np.quantile(ranks, target, method="higher")))

    def _to(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = _distances(x[:, : self.half], self.left) if self.half else np.zeros((len(x), 1))
        return left, _distances(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        left, right = self._to(x)
        return left.argmin(axis=1) * len(self.right) + right.argmin(axis=1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The cells that each of the vectors visits, its own first."""
        return multi_sequence(*self._to(x), self.count)


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(nodes: DataFrame, min_cosine: float) -> dict[int, Index]:
    """An index for each dimension with more vectors than a few cells hold, from a bounded sample chosen by hash."""
    dim = F.size("v").alias("dim")
    large = nodes.groupBy(dim).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * PER_CELL).collect()
    words = {r["dim"]: min(CODEWORDS, math.ceil(math.sqrt(r["n"] / PER_CELL))) for r in large}
    if not words:
        return {}
    h = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in large for x in (r["dim"], int(min(1.0, max(SAMPLE, SAMPLE_EACH * words[r["dim"]]) / r["n"]) * (1 << 30)) + 1)])
    by_dim: dict[int, list] = {}
    for r in nodes.where(h < share[F.size("v")]).orderBy("node").select("v").toLocalIterator():
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    return {d: Index(_unit(v), min_cosine, words[d]) for d, v in by_dim.items()}


def near_vectors(vectors: DataFrame, scratch: Scratch, *, min_cosine: float) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), a row for each row.

    Vectors link if their labels are equal and not null, their dimensions agree, and their cosine
    is min_cosine or more. A vector that is null, empty, zero or holds a null or non-finite value,
    or whose label is null, links with nothing. n_links counts rows, not different vectors. Rows
    that share a vec_id share a component. Rows without a vec_id are left out. A pair that the
    traversal does not reach is not found; the tests measure the recall.
    """
    vectors = vectors.where("vec_id IS NOT NULL")
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & finite, F.lit(False))
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"), valid.alias("valid"))
    keyed = keyed.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit("second"), "v", "label")})
    keys = scratch.stage(keyed.select("vec_id", "valid", "k1", "k2"))
    groups = keyed.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.stage(groups)
    found = _links(nodes, scratch, min_cosine) if nodes.limit(1).count() else None
    if found is None:
        return keys.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = found
    labels = components(edges, scratch)
    per = counts.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    per = nodes.select("k1", "k2", "node", "copies").join(per, ["k1", "k2"], "left").join(labels, "node", "left")
    per = scratch.stage(per.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    out = keys.join(per.withColumn("valid", F.lit(True)), ["k1", "k2", "valid"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(nodes: DataFrame, scratch: Scratch, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, n) of linked rows by tile, and star edges (a, b) between nodes."""
    index = nodes.sparkSession.sparkContext.broadcast(_fit(nodes, min_cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                visits: list = [[0]] * b.num_rows  # dimensions without an index have one cell
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    if d in index.value:
                        rows = np.flatnonzero(dims == d)
                        x = _unit(b.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                        for n, v in zip(rows.tolist(), index.value[d].visits(x), strict=True):
                            visits[n] = v
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*b.schema.names, "visits"])

    placed = nodes.withColumn("dim", F.size("v"))
    placed = scratch.stage(placed.mapInArrow(trimmed(place), T.StructType([*placed.schema, T.StructField("visits", T.ArrayType(T.IntegerType()))])))
    cell = ["label", "dim", "cell"]
    visits = placed.select("k1", "k2", "node", "copies", "label", "dim", "v", "visits", F.posexplode("visits").alias("nth", "cell"))
    # cells above a tile's size are cut into blocks of members and of visits; there are few of them
    sizes = visits.groupBy(cell).agg(F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).alias("m"), F.count(F.lit(1)).alias("p"))
    sizes = sizes.where("m > 0").select(*cell, F.ceil(F.col("m") / TILE).cast("int").alias("bm"), F.ceil(F.col("p") / TILE).cast("int").alias("bp"))
    rows = visits.join(scratch.stage(sizes), cell)  # a visit to a cell without members ends here
    h = F.xxhash64("k1", "k2")
    rows = rows.withColumns({"i": F.pmod(h, F.col("bm")).cast("int"), "j": F.pmod(h, F.col("bp")).cast("int")})
    rows = rows.withColumn("is_member", F.explode(F.when(F.col("nth") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumn("block", F.explode(F.when(F.col("is_member"), F.sequence(F.lit(0), F.col("bp") - 1)).otherwise(F.sequence(F.lit(0), F.col("bm") - 1))))
    rows = rows.withColumns({"i": F.when(F.col("is_member"), F.col("i")).otherwise(F.col("block")), "j": F.when(F.col("is_member"), F.col("block")).otherwise(F.col("j"))})
    tile = [F.xxhash64(*cell, "i", "j").alias("t1"), F.xxhash64(F.lit("second"), "j", "i", *cell).alias("t2")]  # 128 bits tell tiles apart
    rows = rows.select(*tile, "dim", "cell", "is_member", "k1", "k2", "node", "copies", "v", "visits").repartition("t1", "t2").sortWithinPartitions("t1", "t2", "is_member")

    def compare(c: dict[str, np.ndarray], v: pa.Array, visits: pa.Array) -> list[np.ndarray] | None:
        """One tile, visitors first: k1, k2, n, a, b of the rows that have links there."""
        n = int(np.searchsorted(c["is_member"], True))
        if not 0 < n < len(c["is_member"]):
            return None
        x = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(c["dim"][0])))
        x, y = x[:n], x[n:]
        cosines = x @ y.T
        own = {k: m for m, k in enumerate(zip(c["k1"][n:].tolist(), c["k2"][n:].tolist(), strict=True))}
        for m, k in enumerate(zip(c["k1"][:n].tolist(), c["k2"][:n].tolist(), strict=True)):
            if k in own:
                cosines[m, own[k]] = -2
        p, q = np.nonzero(cosines >= min_cosine)
        if not len(p):
            return None
        copies_p, copies_q = c["copies"][:n], c["copies"][n:]
        ends = visits.offsets.to_numpy()
        flat = visits.values.to_numpy()
        width = int(np.diff(ends).max())
        cells = np.full((len(ends) - 1, width), -1, np.int32)
        cells[np.arange(width) < np.diff(ends)[:, None]] = flat[ends[0] : ends[-1]]
        for_p = np.bincount(p, weights=copies_q[q], minlength=n).astype(np.int64)
        # a member that visits the visitor's cell counts the pair there
        there = cells[:n, 0][p]
        lone = np.flatnonzero(there != c["cell"][0])
        lone = np.concatenate([part[~(cells[n:][q[part]] == there[part][:, None]).any(axis=1)] for part in np.array_split(lone, 1 + len(lone) // 100_000)])
        for_q = np.bincount(q[lone], weights=copies_p[p[lone]], minlength=len(y)).astype(np.int64)
        # stars: labels of the tile's components by repeated minima over its links
        low_p, low_q = c["node"][:n].copy(), c["node"][n:].copy()
        while True:
            before = low_p.copy(), low_q.copy()
            np.minimum.at(low_p, p, low_q[q])
            np.minimum.at(low_q, q, low_p[p])
            if (before[0] == low_p).all() and (before[1] == low_q).all():
                break
        count, low = np.append(for_p, for_q), np.append(low_p, low_q)
        some = (count > 0) | (low != c["node"])
        return [c["k1"][some], c["k2"][some], count[some], low[some], c["node"][some]]

    names, ints = ["k1", "k2", "n", "a", "b"], ["t1", "t2", "dim", "cell", "is_member", "k1", "k2", "node", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def tiles(t: pa.Table, ends: list[int]) -> pa.RecordBatch:
            cols = {k: t.column(k).to_numpy() for k in ints}
            v, visits = (t.column(k).combine_chunks() for k in ("v", "visits"))
            out, start = [], 0
            for end in ends:
                found = compare({k: c[start:end] for k, c in cols.items()}, v.slice(start, end - start), visits.slice(start, end - start))
                out += [found] if found else []
                start = end
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]), pa.int64()) for k in range(5)], names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            t1, t2 = t.column("t1").to_numpy(), t.column("t2").to_numpy()
            ends = np.flatnonzero((np.diff(t1) != 0) | (np.diff(t2) != 0)) + 1
            if len(ends):
                yield tiles(t, ends.tolist())
            rest = t.slice(ends[-1] if len(ends) else 0).combine_chunks()
        if rest is not None and rest.num_rows:
            yield tiles(rest, [rest.num_rows])

    found = scratch.stage(rows.mapInArrow(trimmed(run), "k1 long, k2 long, n long, a long, b long"))
    return found.where("n > 0").select("k1", "k2", "n"), found.where("a < b").select("a", "b")


def op1_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.finish(near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), scratch, min_cosine=0.98))

"""Exact Jaccard join of word-shingle sets over size-banded tiles.

Sizes: linked sets differ in size by the threshold at most, so each size band is compared with itself and
with the little of the next band that it can reach.
Tiles: within a band, a tile holds the sets that have one shingle among their first ones. All sets order their
shingles alike, by how many documents of a sample hold them: rare ones first. Of n shingles, linked sets share
n * num / den or more, so that they share LEAST of their first n - n * num / den + LEAST (see tile_keys): no
link is lost, whatever the sample is, and passages that many documents hold make no tiles for
documents that have enough else. Tiles carry ids, sizes and brief bitmaps; a pair that these rule out is never sent.
The shared tiles of other pairs are counted, and pairs that share fewer than LEAST are dropped.
Bitmaps: a set's hashed bitmap bounds an overlap from above: every bit that one has and the other
lacks is at least one shingle that is not shared. Of the pairs left, those whose bound falls short are
dropped. Then the sorted shingle arrays of what is left are intersected exactly.

Copies with equal sets are one node. Every node is first compared with the middles of its tiles, the STAR that share
most tiles with it; a tile's middle is the node whose shingles are the most usual, which in a group of edited
copies is the least edited. Only nodes of a tile that these links leave in different components are compared with
each other: in the order of the tiles they share, in rounds, after each of which pairs whose components have
become one are left out. So a large group of near copies does not make all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, extended, small, small_batches, table, trimmed

#: A bitmap has so many bits for each shingle, rounded up to a power of two; fuller ones bound too little.
BITS_EACH, LEAST_BITS = 8, 512
#: A brief bitmap, which travels with every tile row; beyond about so many shingles it is full and rules out little.
BRIEF_BITS = 1024
BAND_RATIO, BLOCK, LEAST = 1.5, 512, 3
#: The sample for the order: a share of the documents, but so many at least; and its most frequent shingles, broadcast (12 bytes each).
SAMPLE_SHARE, SAMPLE_DOCS, POPULAR = 0.01, 10_000, 1_000_000
#: Nodes of a tile from which on their bitmaps travel with them, instead of its pairs.
DENSE = 128
#: Middles of its tiles with which a node is compared first; pairs that a task holds before it sends them.
STAR, HELD = 3, 1 << 19
#: Pairs whose brief bitmaps are compared at a time.
JUDGED = 1 << 15
_CACHE = 200_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles; A-Z lowered, words by ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(known.__getitem__, w), np.uint64, n)
    size = min(words, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _C1 + a[k : n - size + 1 + k])
    return np.unique(h)


class Bands:
    """Size bands; num / den is the least Jaccard similarity."""

    def __init__(self, num: int, den: int, top: int = 1 << 31):
        self.num, self.den = num, den
        self.lows = [max(1, -(-num // (den - num)))]  # smaller sets that differ are never similar enough
        while self.lows[-1] < top:
            self.lows.append(max(self.lows[-1] + 1, math.floor(self.lows[-1] * BAND_RATIO)))

    def of(self, size: int) -> list[int]:
        """The bands whose tiles a set of this size stands in."""
        if size < self.lows[0]:
            return []
        band = int(np.searchsorted(self.lows, size, "right")) - 1
        below = band > 0 and (self.lows[band] - 1) * self.den >= self.num * size
        return [band - 1, band] if below else [band]


def tile_keys(h: np.ndarray, bands: Bands, popular: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The tiles of a sorted set: hashes of (band, shingle) of its first shingles, the rarest first, then by hash.

    Linked sets share t >= size * num / den shingles, whichever size is taken, as their union has no fewer than
    either. Of the shared ones, the LEASTth in order has t - LEAST more after it in either set, so it stands
    among the first size - t + LEAST of both. If t is less than LEAST, all shingles are first ones, and t are shared.
    Both stand in the smaller one's band (see of).
    """
    own = bands.of(len(h))
    if not own:
        return np.zeros(0, np.uint64)
    first = min(len(h), len(h) - -(-len(h) * bands.num // bands.den) + LEAST)
    if len(popular):
        at = np.minimum(np.searchsorted(popular, h), len(popular) - 1)
        h = h[np.argsort(np.where(popular[at] == h, often[at], 0), kind="stable")]
    return np.concatenate([_mix(h[:first] ^ _mix(np.full(1, band + 1, np.uint64) * _C1)) for band in own])


def shared_tiles(n: Column, num: int, den: int) -> Column:
    """Tiles that linked sets share at least; n is the smaller one's size."""
    return F.least(F.lit(LEAST), F.ceil(n * num / den))


def central(h: np.ndarray, popular: np.ndarray, often: np.ndarray) -> int:
    """How often a set's shingles are in the sample, on average, in hundredths: in a group of edited copies, most where fewest were edited."""
    if not len(popular) or not len(h):
        return 0
    at = np.minimum(np.searchsorted(popular, h), len(popular) - 1)
    return int(np.where(popular[at] == h, often[at], 0).mean() * 100)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Low bits of hashes set a bit each. Halving a bitmap by or-ing its halves gives the bitmap of half the width."""
    width = max(LEAST_BITS, 1 << (BITS_EACH * len(h) - 1).bit_length()) if len(h) else LEAST_BITS
    bits = np.zeros(width, bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def brief(h: np.ndarray) -> bytes:
    """bitmap() in BRIEF_BITS, whatever the set's size."""
    bits = np.zeros(BRIEF_BITS, bool)
    bits[(h & np.uint64(BRIEF_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def halved(bits: np.ndarray, to: int) -> np.ndarray:
    while len(bits) > to:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _popular(docs: DataFrame, words: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, documents that hold them) of those that two documents of the sample or more hold, POPULAR at most."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [shingles(t.as_py(), words, known) for t in b.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("text")
    counts = scratch.stage(chosen.mapInArrow(trimmed(run), "h long").groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1"))
    total, least = 0, 1 << 30
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("n").desc()).collect():  # grows with the root of the sample's shingles
        total += r["k"]
        if total > POPULAR:
            break
        least = r["n"]
    found = counts.where(F.col("n") >= least).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _profiles(docs: DataFrame, words: int, num: int, den: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, central, k1, k2, bits, brief, tiles) of each row; k1 and k2 are 128 bits of the whole set."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = WordHashes(), Bands(num, den)
        popular, often = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, middle, k1, k2, bits, short, tiles = [], [], [], [], [], [], []
                for t in b.column("text"):
                    h = shingles(t.as_py(), words, known)
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    n.append(len(h))
                    k1.append(int.from_bytes(d[:8], "little", signed=True))
                    k2.append(int.from_bytes(d[8:], "little", signed=True))
                    middle.append(central(h, popular, often))
                    bits.append(bitmap(h))
                    short.append(brief(h))
                    tiles.append(tile_keys(h, bands, popular, often).view(np.int64))
                cols = [b.column("doc_id"), pa.array(n, pa.int32()), pa.array(middle, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(tiles, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "central", "k1", "k2", "bits", "brief", "tiles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, n int, central long, k1 long, k2 long, bits array<long>, brief binary, tiles array<long>")


def _enough(shared: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    return shared * (num + den) >= (na + nb).cast("long") * num


def _bounded(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow enough overlap."""
    a = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))

    def half(x: Column) -> Column:
        n = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseOR(q))

    def alike(x: str, y: str) -> Column:
        """Sizes of linked sets differ too little for widths more than one halving apart; others are dropped by size before."""
        return F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))

    def lacking(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)

    both = a.join(small(pairs), "a").join(b, "b").where(_enough(F.least("na", "nb"), F.col("na"), F.col("nb"), num, den))
    both = both.select("a", "b", "na", "nb", alike("bits_a", "bits_b").alias("bits_a"), alike("bits_b", "bits_a").alias("bits_b"))
    bound = F.least(F.col("na") - lacking("bits_a", "bits_b"), F.col("nb") - lacking("bits_b", "bits_a"))
    return both.where(_enough(bound, F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _exact(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by intersection of their sorted arrays.

    The partners of an `a` are dealt to tasks in parts of about BLOCK; the text of `a` goes to each part once.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids), "doc_id")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    partners = pairs.join(small(parts), "a").select("a", part, "b").join(texts.toDF("b", "text"), "b")
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b")).join(texts.toDF("a", "text"), "a")
    rows = partners.select("a", "part", "b", "text").union(centres.select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        here: tuple | None = None
        own: list[np.ndarray] = []  # rows that share a doc_id are one document
        for r in batches:
            found = []
            for a, part, b, text in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist(), r.column(3), strict=True):
                if (a, part) != here:
                    here, own = (a, part), []
                q = shingles(text.as_py(), words, known)
                if b is None:
                    own.append(q)
                    continue
                for p in own:
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if shared and shared * den >= num * (len(p) + len(q) - shared):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(trimmed(run), "a long, b long").distinct()


def _blocks(mixed: DataFrame) -> DataFrame:
    """mixed (tile, node, n, label, nodes) -> a row for each pair of blocks (tile, i, j) that a node's own block is in, about BLOCK nodes each."""
    blocks = F.ceil(F.col("nodes") / F.lit(BLOCK)).cast("int")
    rows = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n")


def _across_dense(mixed: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that share a tile and whose bitmaps allow enough overlap, for tiles of many nodes.

    Here a tile's nodes bring their bitmaps, once for each pair of blocks, as most of its pairs would share enough tiles:
    a large group of copies that were edited a little too much for links takes no row for each of its pairs.
    """
    s = sketches.select(F.col("doc_id").alias("node"), "bits")
    rows = _blocks(mixed).join(s, "node").select("tile", "i", "j", "own", "node", "label", "n", "bits")
    rows = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "own")

    def pairs_of(group: list[tuple]) -> Iterator[tuple[int, int]]:
        *ints, raw = zip(*group, strict=True)
        _, i, j, own, node, label, n = (np.array(c, np.int64) for c in ints)
        least = min(map(len, raw))
        bits = np.array([halved(x, least) for x in raw]).view(np.uint64)
        for x in np.flatnonzero(own == i[0]):
            later = node > node[x] if i[0] == j[0] else own == j[0]
            y = np.flatnonzero(later & (label != label[x]) & (np.minimum(n, n[x]) * den >= np.maximum(n, n[x]) * num))
            if len(y):
                x_lacks = np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64)
                y_lacks = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64)
                y = y[np.minimum(n[x] - y_lacks, n[y] - x_lacks) * (num + den) >= num * (n[x] + n[y])]
                yield from ((min(node[x], v), max(node[x], v)) for v in node[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return batch

        for r in batches:
            cols = [c.to_pylist() for c in r.columns[:-1]] + [[np.array(x.as_py(), np.int64) for x in r.columns[-1]]]
            for row in zip(*cols, strict=True):
                if group and row[:3] != group[0][:3]:
                    found.update(pairs_of(group))
                    group = []
                    if len(found) > 50_000:
                        yield flush()
                group.append(row)
        if group:
            found.update(pairs_of(group))
        yield flush()

    return rows.mapInArrow(trimmed(run), "a long, b long").distinct()


def _across(mixed: DataFrame, briefs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, tiles) of different components, of sizes and brief bitmaps that allow a link, that share enough tiles.

    mixed: (tile, node, n, label, nodes) of the tiles that hold more than one label, with the tile's
    number of rows; briefs: (node, brief). Tiles of more than BLOCK nodes are cut into blocks that are compared two at a time.
    """
    rows = _blocks(mixed).join(briefs, "node").select("tile", "i", "j", "own", "node", "label", "n", "brief")
    rows = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "own")

    def pairs_of(node, label, n, left, right) -> tuple[np.ndarray, np.ndarray]:
        """The rows left x right that may be pairs; of one block, each pair once."""
        x, y = np.nonzero(
            (label[left][:, None] != label[right][None, :])
            & (np.minimum(n[left][:, None], n[right][None, :]) * den >= np.maximum(n[left][:, None], n[right][None, :]) * num)
            & ((node[left][:, None] < node[right][None, :]) if left is right else (node[left][:, None] != node[right][None, :]))
        )
        return left[x], right[y]

    def allowed(n, bits, x, y) -> np.ndarray:
        x_lacks = np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64)
        y_lacks = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64)
        return np.minimum(n[x] - y_lacks, n[y] - x_lacks) * (num + den) >= num * (n[x] + n[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        out: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            a, b, n = (np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]) for k in range(3))
            out.clear()
            held = 0
            order = np.lexsort((n, b, a))
            a, b, n = a[order], b[order], n[order]
            start = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if len(a) else np.zeros(0, np.int64)
            cols = [a[start], b[start], n[start], np.diff(np.append(start, len(a)))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n", "tiles"])

        def judge(cols: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
            nonlocal held
            node, n, bits = cols[4], cols[6], cols[7]
            x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            for at in range(0, len(x), JUDGED):
                p, q = x[at : at + JUDGED], y[at : at + JUDGED]
                keep = allowed(n, bits, p, q)
                p, q = p[keep], q[keep]
                out.append([np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), np.minimum(n[p], n[q])])
                held += len(p)
            found.clear()

        def groups(cols: list[np.ndarray], ends: list[int]) -> Iterator[pa.RecordBatch]:
            _, i, j, own, node, label, n, _ = cols
            start, waiting = 0, 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for end in ends:
                if end - start > 1:
                    if i[start] == j[start]:
                        left = right = np.arange(start, end)
                    else:
                        cut = start + int(np.searchsorted(own[start:end], j[start]))
                        left, right = np.arange(start, cut), np.arange(cut, end)
                    found.append(pairs_of(node, label, n, left, right))
                    waiting += len(found[-1][0])
                if found and (waiting > JUDGED or end == ends[-1]):
                    judge(cols, found)
                    waiting = 0
                    if held > HELD:
                        yield flush()
                start = end

        for r in batches:
            cols = [c.to_numpy().astype(np.int64) for c in r.columns[:-1]]
            cols.append(np.frombuffer(b"".join(r.columns[-1].to_pylist()), np.uint64).reshape(-1, BRIEF_BITS // 64))
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            ends = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            yield from groups(cols, ends.tolist())
            rest = [c[ends[-1] :] for c in cols] if len(ends) else cols
        if rest is not None and len(rest[0]):
            yield from groups(rest, [len(rest[0])])
        yield flush()

    rows = rows.mapInArrow(trimmed(run), "a long, b long, n long, tiles long")
    found = rows.groupBy("a", "b").agg(F.sum("tiles").alias("tiles"), F.min("n").alias("n"))
    return found.where(F.col("tiles") >= shared_tiles(F.col("n"), num, den)).select("a", "b", "tiles")


def jaccard_groups(docs: DataFrame, scratch: Scratch, *, words: int, num: int, den: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), one row for each row with a doc_id.

    A set holds the distinct shingles of so many words of a whole text; with fewer words, all of
    them as one; without words it is empty and linked with nothing. Sets link from a Jaccard
    similarity of num / den on; component_id is the smallest doc_id that links reach. Equal sets
    are linked. Rows that share a doc_id are one document: what links one of them links all.
    Rows without a doc_id are left out. Shingles and sets are compared by 64- and 128-bit hashes.
    """
    docs = small_batches(docs).where("doc_id IS NOT NULL")
    rows = scratch.stage(_profiles(docs, words, num, den, _popular(docs, words, scratch)))
    light = rows.select("doc_id", "n", "central", "k1", "k2")
    own = scratch.stage(light.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("central").alias("central")))
    # a tile row is two longs: equal sets have one k1, which stands for them until tiles of one set are gone
    tiles = rows.where("n > 0").select("k1", F.explode("tiles").alias("tile"))
    of_tile = Window.partitionBy("tile")
    shared = tiles.withColumns({"lo": F.min("k1").over(of_tile), "hi": F.max("k1").over(of_tile)}).where("lo < hi")
    shared = scratch.stage(shared.select("tile", "k1").distinct())
    members = shared.join(own.drop("k2"), "k1").select("tile", "node", "n", F.max(F.struct("central", (-F.col("node")).alias("last"), "node", "n")).over(of_tile).alias("mid"))
    members = scratch.stage(members)
    sketches, briefs = rows.select("doc_id", "n", "bits"), rows.select(F.col("doc_id").alias("node"), "brief")
    first = members.where("mid.node <> node").groupBy(F.least("mid.node", "node").alias("a"), F.greatest("mid.node", "node").alias("b"), F.col("node").alias("from"))
    first = first.agg(F.count(F.lit(1)).alias("tiles"), F.min(F.least("n", "mid.n")).alias("n")).where(F.col("tiles") >= shared_tiles(F.col("n"), num, den))
    likely = Window.partitionBy("from").orderBy(F.col("tiles").desc(), "a", "b")  # a node is in many tiles, whose middles differ
    first = first.withColumn("nth", F.row_number().over(likely)).where(F.col("nth") <= STAR).select("a", "b").distinct()
    star = scratch.stage(_bounded(scratch.stage(first), sketches, num, den))
    labels = components(scratch.stage(_exact(star, docs, words, num, den)), scratch)
    label = F.coalesce("component", "node").alias("label")
    labelled = members.select("tile", "node", "n").join(labels, "node", "left").select("tile", "node", "n", label)
    mixed = labelled.withColumns({"l": F.min("label").over(of_tile), "h": F.max("label").over(of_tile), "nodes": F.count(F.lit(1)).over(of_tile)}).where("l < h")
    mixed = scratch.stage(mixed.select("tile", "node", "n", "label", "nodes"))
    # linked sets share a dense tile, or enough others
    near = scratch.stage(_across_dense(mixed.where(F.col("nodes") > DENSE), sketches, num, den).join(star, ["a", "b"], "left_anti"))
    if near.limit(1).count():
        labels = extended(labels, scratch.stage(_exact(near, docs, words, num, den)), scratch)
    alike = scratch.stage(_across(mixed.where(F.col("nodes") <= DENSE), briefs, num, den).join(star, ["a", "b"], "left_anti"))
    # pairs that share most tiles first, a few for each node, then more, then all, as long as their components differ
    for most in (STAR, STAR * 16, None):
        named = labels.toDF("a", "la"), labels.toDF("b", "lb")
        open_ = alike.join(named[0], "a", "left").join(named[1], "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        alike = scratch.stage(open_.select("a", "b", "tiles"))
        if not alike.limit(1).count():
            break
        now = alike
        if most is not None:
            ends = alike.select("*", F.explode(F.array("a", "b")).alias("from"))
            order = Window.partitionBy("from").orderBy(F.col("tiles").desc(), "a", "b")
            now = scratch.stage(ends.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("a", "b").distinct())
            alike = alike.join(now, ["a", "b"], "left_anti")
        found = scratch.stage(_exact(scratch.stage(_bounded(now.select("a", "b"), sketches, num, den)), docs, words, num, den))
        if found.limit(1).count():
            labels = extended(labels, found, scratch)
    # from sets to documents, and documents that share an id or a set to one component
    of_set = scratch.stage(own.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component")))
    out = light.join(of_set, ["k1", "k2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return _united(scratch.stage(out), scratch)


def _united(out: DataFrame, scratch: Scratch) -> DataFrame:
    """Where rows share a doc_id, their components become one."""
    split = out.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b")
    split = scratch.stage(out.join(split.select("doc_id", "a"), "doc_id").where("a < component_id").select("a", F.col("component_id").alias("b")).distinct())
    if not split.limit(1).count():
        return out
    more = components(split, scratch).withColumnRenamed("component", "united")
    return out.join(more, out["component_id"] == more["node"], "left").select("doc_id", "n_shingles", F.coalesce("united", "component_id").alias("component_id"))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.finish(jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text"), scratch, words=3, num=90, den=100))

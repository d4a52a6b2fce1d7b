"""Toxicity by class-conditional Kneser-Ney models.

Two models, one a class, are counted on a bounded sample of labelled documents: bigrams and words by
their distinct left contexts, so that copies and shared passages count once. Their lowest order is shared: P(w) follows from how many different left
contexts w has in the whole corpus, counted exactly for every word of it.
A word's evidence is the difference of its two log-likelihoods; words that neither class has seen
back off to the same shared probability, of which the classes' backoff weights alone remain. A document is judged by two
means over all its words, so that neither grows with length: the mean evidence, and the power mean of order POWER of
the evidence that speaks for label 1, by words alone and shrunk where few contexts support it. The plain mean alone finds few
toxic documents, as a few strong words drown in the noise of rare ones (figures in the README); the
power mean lets strong expressions count. Both are calibrated on labelled documents that were not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table, trimmed

#: Bounds of the labelled sample: documents and bytes a class that are expected, bytes of one document; one in CALIBRATE calibrates, the others are counted.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT, CALIBRATE = 4000, 64 << 20, 8 << 20, 4
DISCOUNT, CLIP, POWER = 0.75, 8.0, 4
#: A word's evidence counts in the power mean by n / (n + RELIABLE), where n are its distinct left contexts in both classes.
RELIABLE = 8.0
#: Words with more than one place of FREQUENT are dealt in PARTS; a task sends its counts after so many PLACES.
FREQUENT, PARTS, PLACES = 2000, 32, 1 << 22
#: Buckets of words for each shuffle partition; tells the parts of a word apart.
BUCKETS, _PART = 8, np.uint64(0x9E3779B97F4A7C15)

_keep = b"abcdefghijklmnopqrstuvwxyz0123456789'"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _keep else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lowered; ASCII marks and white space separate."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _labelled(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, float]:
    """A bounded sample (doc_id, text, toxic, part) of the labelled documents, by hash of doc_id, and the share of toxic labels."""
    lab = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = dict(lab.groupBy("toxic").count().collect())
    h = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    share = lambda c: math.ceil(min(1.0, sample_docs / max(1, counts.get(c, 0))) * (1 << 30))
    lab = lab.where(((F.col("toxic") == 1) & (h < share(1))) | ((F.col("toxic") == 0) & (h < share(0))))
    lab = lab.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATE)) == 0, "calibrate").otherwise("count"))
    # about twice sample_docs rows are broadcast, at whatever input
    sample = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT)
    for c, size in sample.groupBy("toxic").agg(F.sum(F.octet_length("text"))).collect():
        if (size or 0) > SAMPLE_BYTES:
            part = F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30))
            sample = sample.where((F.col("toxic") != c) | (part < int(SAMPLE_BYTES / size * (1 << 30))))
    return sample, counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))


class _Ids(dict):
    """Numbers of words in the order of their first place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))


class Model:
    """What scoring needs: word ids, evidence by word and by bigram, the change a context makes, and the calibration."""

    def __init__(self, vocabulary, unigram, context, keys, bigram, reliable):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.unigram, self.context, self.keys, self.bigram = unigram, context, keys, bigram
        self.strong = np.clip(unigram, -CLIP, CLIP) * reliable
        self.weights = np.zeros(3)

    def evidence(self, text: str | None) -> np.ndarray:
        """log P_toxic(w | v) - log P_ordinary(w | v) of each word."""
        get = self.ids.get
        w = words(text)
        if not w:
            return np.zeros(0)
        n, size = len(w), len(self.unigram) - 1
        ids = self._at = np.fromiter((get(x, size) for x in w), np.int64, n)
        out = self.unigram[ids]
        out[1:] += self.context[ids[:-1]]
        if n > 1 and len(self.keys):
            key = ids[:-1] * (size + 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[1:] = np.where(self.keys[at] == key, self.bigram[at], out[1:])
        return np.clip(out, -CLIP, CLIP)

    def features(self, text: str | None) -> np.ndarray:
        """1, the mean evidence of all words, and the power mean of what speaks for label 1."""
        e = self.evidence(text)
        if not len(e):
            return np.array([1.0, 0.0, 0.0])
        return np.array([1.0, e.mean(), (np.maximum(self.strong[self._at], 0) ** POWER).mean() ** (1 / POWER)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -50, 50))))


def corpus_counts(docs: DataFrame, frequent: np.ndarray | None = None) -> DataFrame:
    """docs (text) -> a row (word, n, contexts) for every word of all documents: its xxh3, its places and its distinct left words."""
    return _part_counts(docs, frequent).groupBy("word").agg(F.sum("n").alias("n"), F.sum("contexts").alias("contexts"))


def _part_counts(docs: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """The same, where a frequent word has a row for each of its parts, whose sums are the word's.

    Tasks send the distinct left words of their words as hashes (32 bits, told apart a word), packed a bucket of words; what is equal between
    tasks counts once, exactly but for collisions. frequent (hashes, sorted) are dealt in PARTS by left word, so that no task holds all of one.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.zeros(0, np.uint64) if frequent is None else frequent)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(ids: _Ids, keys: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(keys, return_counts=True)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        w, left = keys >> 32, keys & 0xFFFFFFFF  # left is 0 where a text begins
        lh = np.append(np.uint64(0), h)[left]
        part = np.where(np.isin(h, held.value)[w], lh % np.uint64(PARTS), np.uint64(0))
        key = h[w] + part * _PART
        bucket = (key * _PART >> np.uint64(33)) % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, part, bucket, left, lh, n = key[order], part[order], bucket[order], left[order], lh[order], n[order]
        start = np.flatnonzero(np.append(True, np.diff(key) != 0))  # equal keys are of one bucket
        size = np.add.reduceat((left > 0).astype(np.int64), start)
        n, lefts = np.add.reduceat(n, start), (lh[left > 0] >> np.uint64(32)).astype(np.uint32)
        key, part, bucket = key[start], part[start].astype(np.uint8), bucket[start].astype(np.int32)
        ends = np.append(0, np.cumsum(size))
        first = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        zip_ = zstandard.ZstdCompressor(level=1).compress
        data = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            columns = [np.array([b - a], np.uint32), key[a:b], part[a:b], n[a:b].astype(np.uint32), size[a:b].astype(np.uint32), lefts[ends[a] : ends[b]]]
            data.append(zip_(b"".join(c.tobytes() for c in columns)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, places = _Ids(), [], 0
        for b in batches:
            for t in b.column(0):
                w = words(t.as_py())
                if w:
                    x = ids.of(w)
                    keys.append(x << 32 | np.append(0, x[:-1] + 1))
                    places += len(w)
                    if places >= PLACES:
                        yield packed(ids, np.concatenate(keys))
                        ids, keys, places = _Ids(), [], 0
        if places:
            yield packed(ids, np.concatenate(keys))

    def unpacked(data: bytes) -> list[np.ndarray]:
        """(key, part, n, size, lefts)"""
        raw = zstandard.ZstdDecompressor().decompress(data)
        count, at, out = int.from_bytes(raw[:4], "little"), 4, []
        for kind in (np.uint64, np.uint8, np.uint32, np.uint32):
            out.append(np.frombuffer(raw, kind, count, at))
            at += count * out[-1].itemsize
        return [*out, np.frombuffer(raw, np.uint32, offset=at)]

    def together(some: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The same of several, each word once and each of its left words once."""
        key, part, n, size, lefts = (np.concatenate(c) for c in zip(*some, strict=True))
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.repeat(at, size) << 32 | lefts)
        return [key, part[first], np.bincount(at, weights=n).astype(np.int64), np.bincount(pairs >> 32, minlength=len(key)), (pairs & 0xFFFFFFFF).astype(np.uint32)]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, some, waiting = None, [], 0

        def done() -> pa.RecordBatch:
            key, part, n, size, _ = together(some)
            return pa.RecordBatch.from_arrays([pa.array((key - part * _PART).view(np.int64)), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["word", "n", "contexts"])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != here:
                    if some:
                        yield done()
                    here, some, waiting = bucket, [], 0
                some.append(unpacked(data.as_py()))
                waiting += len(some[-1][-1])
                if waiting > PLACES:
                    some, waiting = [together(some)], 0
        if some:
            yield done()

    rows = small_batches(docs).select("text").mapInArrow(trimmed(deal), "bucket int, data binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(merged), "word long, n long, contexts long")


def _contexts(docs: DataFrame, vocabulary: list[bytes], frequent: np.ndarray) -> tuple[np.ndarray, float]:
    """Distinct left contexts in all documents of each word of the vocabulary, and the sum of contexts + 0.5 over all words there are.

    frequent words are of the vocabulary, so that a word outside it has one part.
    """
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary)).view(np.int64)
    order = np.argsort(h)
    held = docs.sparkSession.sparkContext.broadcast((h[order], order))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = held.value
        others = 0.0
        for b in batches:
            word, contexts = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            hit = known[at] == word
            others += (contexts[~hit] + 0.5).sum()
            yield pa.RecordBatch.from_arrays([pa.array(number[at[hit]]), pa.array(contexts[hit], pa.float64())], names=["id", "contexts"])
        yield pa.RecordBatch.from_arrays([pa.array([len(known)], pa.int64()), pa.array([others], pa.float64())], names=["id", "contexts"])

    out = np.zeros(len(vocabulary) + 1)
    for t in _part_counts(docs, frequent).select("word", "contexts").mapInArrow(trimmed(pick), "id long, contexts double").toArrow().to_batches():
        np.add.at(out, t.column(0).to_numpy(), t.column(1).to_numpy())
    return out[:-1], out.sum() + 0.5 * len(vocabulary)


def learn(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs (doc_id, text) of the whole corpus and labels (doc_id, toxic) of the training rows -> a calibrated model.

    Without rows of both classes every score is the share of toxic labels, or 0 without labels.
    """
    sample, share = _labelled(docs, labels, sample_docs)
    sample = sample.select("text", "toxic", "part")
    counted: list[tuple[int, np.ndarray]] = []
    calibrate: list[tuple[int, str]] = []
    ids = _Ids()
    seen: set[int] = set()
    for r in sample.toLocalIterator():
        text = r["text"] or ""
        h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), r["toxic"])
        if h in seen:
            continue  # copies teach once
        seen.add(h)
        if r["part"] == "calibrate":
            calibrate.append((r["toxic"], text))
        else:
            counted.append((r["toxic"], ids.of(words(text)).astype(np.int32)))
    vocabulary = list(ids)
    n_classes = len({t for t, _ in counted} & {0, 1}), len({t for t, _ in calibrate} & {0, 1})
    if min(n_classes) < 2:
        model = Model([], np.zeros(1), np.zeros(1), np.zeros(0, np.int64), np.zeros(0), np.zeros(1))
        model.weights = np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0])
        return model
    contexts, total = _contexts(docs, vocabulary, _frequent(vocabulary, counted))
    model = _estimate(vocabulary, counted, contexts, total)
    model.weights = _calibrate(np.array([model.features(t) for _, t in calibrate]), np.array([c for c, _ in calibrate], float), share)
    return model


def _frequent(vocabulary: list[bytes], counted: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Hashes of the words that hold one place of FREQUENT in the counted documents."""
    n = np.bincount(np.concatenate([x for _, x in counted]), minlength=len(vocabulary))
    return np.sort(np.array([xxhash.xxh3_64_intdigest(vocabulary[i]) for i in np.flatnonzero(n * FREQUENT > n.sum())], np.uint64))


def _estimate(vocabulary: list[bytes], counted: list[tuple[int, np.ndarray]], contexts: np.ndarray, total: float) -> Model:
    """Every word and bigram of the counted documents (class, word ids) has its place; the discount and the shared backoff smooth rare ones."""
    size = len(vocabulary)
    shared = (contexts + 0.5) / total
    lower, gamma, pair, joint, backoff, reliable = [], [], [], [], [], np.zeros(size + 1)
    for c in (0, 1):
        texts = [x.astype(np.int64) for t, x in counted if t == c and len(x) > 1]
        one = np.unique(np.concatenate([x[1:] * (size + 1) + x[:-1] for x in texts] or [np.zeros(0, np.int64)]))
        left = np.bincount(one // (size + 1), minlength=size + 1)  # distinct left contexts in this class
        keys, at = np.unique(np.concatenate([x[1:-1] * (size + 1) + x[2:] for x in texts] or [np.zeros(0, np.int64)]), return_inverse=True)
        before = np.concatenate([x[:-2] for x in texts] or [np.zeros(0, np.int64)])
        n = np.bincount(np.unique(at * (size + 1) + before) // (size + 1), minlength=len(keys))  # and of bigrams: copies add nothing
        v = keys // (size + 1)
        lam = DISCOUNT * max(1, (left > 0).sum()) / max(1, left.sum())
        p = np.maximum(left[:size] - DISCOUNT, 0) / max(1, left.sum()) + lam * shared
        places, kinds = np.bincount(v, weights=n, minlength=size + 1), np.bincount(v, minlength=size + 1)
        g = np.where(places > 0, DISCOUNT * kinds / np.maximum(places, 1), 1.0)
        lower.append(p)
        backoff.append(lam)
        gamma.append(g)
        pair.append(keys)
        joint.append((n - DISCOUNT) / places[v])
        reliable += left
    keys = np.union1d(*pair)
    v, w = keys // (size + 1), keys % (size + 1)
    log_p = []
    for c in (0, 1):
        high = np.zeros(len(keys))
        high[np.searchsorted(keys, pair[c])] = joint[c]
        log_p.append(np.log(high + gamma[c][v] * lower[c][w]))
    # a word outside the sample has lam * P(w) in either class, so that P(w) cancels whatever it is
    unigram = np.append(np.log(lower[1]) - np.log(lower[0]), math.log(backoff[1] / backoff[0]))
    return Model(vocabulary, unigram, np.log(gamma[1]) - np.log(gamma[0]), keys, log_p[1] - log_p[0], reliable / (reliable + RELIABLE))


def _calibrate(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression by Newton's steps with a small penalty; classes weigh as their labels' shares."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) -> the same rows with toxic_score in 0 to 1.

    Null, empty and wordless texts carry no evidence and get the calibration's constant. Rows
    are independent; broadcast is the model, bounded by the sample.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "toxic_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores = pa.array([m.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], scores], names=[*names, "toxic_score"])

    return small_batches(docs).mapInArrow(trimmed(run), docs.select(*names).schema.add("toxic_score", "double"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    out = predict(docs, model)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    score = F.col("toxic_score")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))

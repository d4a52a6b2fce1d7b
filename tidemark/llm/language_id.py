"""Language ID by compression: one zstandard raw-content dictionary a language; the smallest frame wins, unless the next is too near."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table, trimmed

#: Bounds of the training sample: bytes of raw content a language and of all, bytes that one document may give.
DICT_BYTES, MODEL_BYTES, DOC_BYTES = 200_000, 48 << 20, 400
#: More values of lang than this are no languages.
MAX_LANGUAGES = 10_000
#: zstandard level, bytes that are compressed at a time, and the least margin of the runner-up's size over the smallest: relative, and in bytes.
LEVEL, PIECE_BYTES, MIN_MARGIN, MIN_BYTES = 6, 4096, 0.002, 2
_HASH_SPAN = 1 << 30
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def _plain(text: str) -> bytes:
    """Lower-case letters with single spaces: case, digits and marks say nothing of the language."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(docs: DataFrame, *, dict_bytes: int = DICT_BYTES, doc_bytes: int = DOC_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, most frequent language first, from a bounded sample of docs (doc_id, text, lang).

    The sample is by hash of doc_id: twice the documents that fill dict_bytes are expected, each
    gives doc_bytes at most, from a place in its whole text that the hash chooses. Rows without text or lang teach
    nothing. With many languages each has its share of MODEL_BYTES.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPAN)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    dict_bytes = min(dict_bytes, MODEL_BYTES // len(counts))
    want = 2 * dict_bytes / doc_bytes
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, math.ceil(min(1.0, want / n) * _HASH_SPAN))])
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - 2 * doc_bytes)).cast("int")
    sample = rows.where(F.col("_h") < share[F.col("lang")]).select("lang", "_h", F.substring(F.col("text"), place, F.lit(2 * doc_bytes)).alias("text"))
    out: dict[str, dict[bytes, None]] = {lang: {} for lang in counts}
    size = dict.fromkeys(counts, 0)
    for r in sorted(sample.toLocalIterator(), key=lambda r: (r["lang"], r["_h"], r["text"])):
        raw = _plain(r["text"])[:doc_bytes]
        if size[r["lang"]] + len(raw) < dict_bytes and raw not in out[r["lang"]]:
            out[r["lang"]][raw] = None
            size[r["lang"]] += len(raw) + 1
    return {lang: b"\n".join(out[lang]) for lang in sorted(out, key=lambda x: (-counts[x], x)) if out[lang]}


def _compressors(model: dict[str, bytes], level: int) -> list:
    out = []
    for raw in model.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def guess(text: str | None, langs: list[str], compressors: list, min_margin: float, min_bytes: int) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text, compressed piece by piece so that each piece meets the dictionaries."""
    if text is None or not langs or not _LETTER.search(text):
        return "und", 0.0, True
    raw = _plain(text)
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = [sum([len(c.compress(p)) for p in pieces]) for c in compressors]
    best = sizes.index(min(sizes))
    score = 1 / sum(2.0 ** -min(60, s - sizes[best]) for s in sizes)
    runner_up = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
    return langs[best], score, runner_up - sizes[best] < max(min_bytes, min_margin * sizes[best])


def predict(docs: DataFrame, model: dict[str, bytes], *, level: int = LEVEL, min_margin: float = MIN_MARGIN, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs (with text) -> the same rows with lang_pred, lang_score and lang_rejected.

    und, score 0 and rejected: null, empty and letterless texts (without a character of category L), or no model. A tie goes to the
    language with more training rows, and counts as a narrow margin, as does one of fewer than min_bytes: short texts that two languages share. Each row is judged by itself, from
    its whole text; broadcast is the model, at most dict_bytes times the languages.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.schema([("lang_pred", pa.string()), ("lang_score", pa.float64()), ("lang_rejected", pa.bool_())])
    names = [c for c in docs.columns if c not in fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, compressors = list(held.value), _compressors(held.value, level)
        for b in batches:
            found = [guess(t.as_py(), langs, compressors, min_margin, min_bytes) for t in b.column("text")]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(fields.types)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + cols, names=names + fields.names)

    schema = docs.select(*names).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    return small_batches(docs).mapInArrow(trimmed(run), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(training_rows(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    out = predict(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's docs.

Rejected languages go; repeated lines go; one document of each near-duplicate group stays; documents
that hold benchmark items go; what is left is encoded into pieces.

Every stage gives no rows for no rows, reads whole texts of any length, and looks at the columns of documents only, so
that others, whatever their names, change nothing. Rows that share a doc_id are judged by their own texts in the
first and last stage, as one document in the others: what one of them loses or is dropped for, all are. Rows without
a doc_id teach no language, lose no lines and are no near duplicates and not contaminated: they stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.language_id import learn, predict, training_rows
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.piece_encoding import encode_documents
from tidemark.llm.shingle_join import jaccard_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language ID rejects: null and empty texts, no letter, or no language by a clear margin. It learns from docs with a lang."""
    model = learn(training_rows(docs.select("doc_id", "text", "lang")))
    return predict(docs.select(*COLUMNS), model).where("NOT lang_rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that larger doc_ids hold too; n_chars is counted anew. Every document stays, if empty; a null text stays null."""
    scratch = Scratch(spark)
    out = dedup_lines(docs.select(*COLUMNS, F.col("text").isNull().alias("no_text")), scratch)
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    out = out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return scratch.later(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group whose 5-word shingles are linked by a Jaccard similarity of 0.8 or more. Wordless texts are alike to none."""
    with Scratch(spark) as scratch:
        groups = jaccard_groups(docs.select("doc_id", "text"), scratch, words=5, num=80, den=100)
        gone = scratch.finish(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item, or are most of one."""
    with Scratch(spark) as scratch:
        held = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), scratch)
        gone = scratch.finish(held.where("contaminated").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with the end id, their count and digest, and the digest of the decoded text; a null or empty text is the end id alone."""
    out = encode_documents(docs.select("doc_id", "lang", "source", "text"), with_ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("piece_encoding", pieces),
]

#: SQL has no compression models or piece merges; tests/llm compares run() with a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; rows of the last."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.stage(docs)
    return scratch.later(docs)

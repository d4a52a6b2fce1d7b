"""A file queue of evaluation jobs as a stream: pending JSON files in, one completed or failed file a job out.

The source's checkpoint hands each file to one batch. A job's record goes to a file of its own name that is renamed
when whole, so a batch that runs again after a failure puts the same files in the same places.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.evaluation import respond
from tidemark.profiles import PROFILES
from tidemark.schema import JOB, RAW_OBSERVATION
from tidemark.shared import Scratch, small
from tidemark.sources import pieces
from tidemark.sources.files import document, file_name, put, store, write_documents, write_in_parts

FOLDERS = ("pending", "completed", "failed")


def ensure(base: str) -> None:
    at, folder = store(base)
    for name in FOLDERS:
        at.create_dir(f"{folder}/{name}", recursive=True)


def enqueue(base: str, observations: list[dict], now: int, profile: str = "BASE", metadata: dict | None = None, job_id: str | None = None) -> str:
    """Writes one pending job, an indented JSON document, and returns its id."""
    ensure(base)
    job_id = job_id or str(uuid.uuid4())
    payload = {"observations": observations, "current_time_utc": now, "applied_profile": profile, "metadata": metadata}
    at, folder = store(base)
    put(at, f"{folder}/pending", file_name(job_id), document({"job_id": job_id, "created_at": time.time(), "payload": payload}))
    return job_id


def ingest(base: str, request: dict) -> dict:
    """Takes a request (observations, current_time_utc, applied_profile, metadata) into the queue and says so."""
    at = time.time()
    job_id = enqueue(base, request["observations"], request["current_time_utc"], request.get("applied_profile") or "BASE", request.get("metadata"))
    return {"status": "ok", "job_id": job_id, "accepted_timestamp": at, "observations_count": len(request["observations"])}


def _jobs(files: DataFrame) -> DataFrame:
    """files (value, file) -> file, job_id, created_at, payload, original (the payload's text) and _corrupt, null if it could be read."""
    job = F.from_json("value", JOB, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j")
    return files.select("file", job, F.get_json_object("value", "$.payload").alias("original")).select("file", "original", "j.*")


def _now():
    return (F.unix_micros(F.current_timestamp()) / 1e6).alias("at")


def _large_jobs(cut: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """pieces.parts() of large jobs -> as _jobs(), payloads without their observations; and these (file, idx, json, copy), copy being {"o": json} in plain JSON."""
    copy = F.when(F.col("idx") >= 0, F.get_json_object(F.concat(F.lit('{"o":'), "json", F.lit("}")), "$"))
    found = scratch.stage(pieces.elements(cut, ("payload", "observations")).withColumn("copy", copy))
    schema = f"{RAW_OBSERVATION.simpleString()[:-1]},_corrupt:string>"
    odd = F.from_json("json", schema, {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull() & (F.col("json") != "null")
    marks = found.select("file", ((F.col("idx") == pieces.BROKEN) | (F.col("idx") >= 0) & odd).alias("unread"), ((F.col("idx") >= 0) & F.col("copy").isNull()).alias("no_copy"))
    marks = scratch.stage(marks.groupBy("file").agg(F.max("unread").alias("unread"), F.max("no_copy").alias("no_copy")))
    heads = _jobs(found.where("idx < 0").select(F.col("json").alias("value"), "file")).join(small(marks), "file")
    heads = heads.withColumns({"_corrupt": F.when(F.col("unread"), "").otherwise(F.col("_corrupt")), "original": F.when(~F.col("no_copy"), F.col("original"))})
    return scratch.stage(heads.drop("unread", "no_copy")), found.where("idx >= 0")


def _write_failed_large(failed: DataFrame, observations: DataFrame, cut: DataFrame, folder: str) -> None:
    """Failed records of large jobs (file, name, json): their observations are put back into the payload, and the text of unreadable jobs into the details."""
    mark = uuid.uuid4().hex

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                record = json.loads(text)
                unreadable, payload = record["error"] == "unreadable job", record["original_payload"]
                listed = isinstance(payload, dict) and isinstance(payload.get("observations"), list)
                if unreadable:
                    record["error_details"]["text"] = mark
                if listed:
                    payload["observations"] = [mark]
                frame = document(record).decode()
                before, frame = frame.split(mark, 1) if unreadable else ("", frame)
                middle, after = re.split(rf'\[\s*"{mark}"\s*\]', frame, maxsplit=1) if listed else (frame, "")
                out.append((unreadable, listed, before, middle, after))
            cols = [pa.array([o[k] for o in out], pa.bool_() if k < 2 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["file", "name", "unreadable", "listed", "before", "middle", "after"])

    def indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [json.dumps(json.loads(text)["o"], ensure_ascii=False, indent=2).replace("\n", "\n      ") for text in b.column(2).to_pylist()]
            parts = [("," if i else "[") + "\n      " + part for i, part in zip(b.column(1).to_pylist(), parts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.string())], names=["name", "nth", "part"])

    def escaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            parts = [json.dumps(part.decode(errors="replace"), ensure_ascii=False)[1:-1] + "}" * closed for part, closed in parts]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts, pa.string())], names=["name", "start", "nth", "part"])

    frames = failed.select("file", "name", "json").mapInArrow(framed, "file string, name string, unreadable boolean, listed boolean, before string, middle string, after string")
    which, zero = small(frames.select("file", "name", "unreadable", "listed")), F.lit(0).cast("long")

    def section(n: int, rows: DataFrame, start: Column = zero, nth: Column = zero, part: str = "part") -> DataFrame:
        return rows.select("name", F.lit(n).alias("section"), start.alias("start"), nth.alias("nth"), F.col(part).alias("part"))

    end = cut.groupBy("file").agg(F.sum(F.octet_length("part") + 1).alias("bytes"), F.max(F.struct("start", "nth")).alias("end"))
    text = cut.join(which.where("unreadable"), "file").join(small(end), "file")
    closed = (F.col("bytes") != F.col("size") + 1) | (F.struct("start", "nth") != F.col("end"))  # a last part without a brace is a byte short
    text = text.select("name", "start", "nth", "part", closed.alias("closed")).mapInArrow(escaped, "name string, start long, nth long, part string")
    rows = observations.join(which.where("listed"), "file")
    listed = rows.select("name", F.col("idx").alias("nth"), "copy").mapInArrow(indented, "name string, nth long, part string")
    some = rows.select("name").distinct().withColumn("some", F.lit(True))
    ends = frames.join(small(some), "name", "left").withColumn("part", F.when(F.col("some"), "\n    ]").when(F.col("listed"), "[]").otherwise(""))
    sections = [section(0, frames, part="before"), section(1, text, F.col("start"), F.col("nth")), section(2, frames, part="middle")]
    sections += [section(3, listed, nth=F.col("nth")), section(4, ends), section(5, frames, part="after")]
    out = sections[0]
    for rows in sections[1:]:
        out = out.unionByName(rows)
    write_in_parts(out, folder, "section", "start", "nth")


def process(jobs: DataFrame, rules: DataFrame, large: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs of a batch -> (completed, failed), rows (file, name, json). One plan a profile evaluates them all, keyed by file; times are a column.

    large: (file, idx, json), the observations of jobs whose payloads do not have them.
    """
    profile = F.coalesce("payload.applied_profile", F.lit("BASE"))
    why = (
        F.when(F.col("_corrupt").isNotNull() | F.col("job_id").isNull() | F.col("payload").isNull(), "unreadable job")
        .when(F.col("payload.current_time_utc").isNull(), "Missing current_time_utc in job payload")
        .when(~profile.isin(list(PROFILES)), F.concat(F.lit("Invalid profile: "), profile))
    )
    jobs = jobs.withColumns({"error": why, "profile": profile, "stem": F.regexp_replace("file", r"\.json$", "")})
    kind = F.when(F.col("error") == "unreadable job", "JSONDecodeError").otherwise("ValueError")
    failure = F.struct(
        "job_id", "created_at", _now().alias("failed_at"), F.lit("failed").alias("status"), "error", F.struct(kind.alias("exception_type"), F.col("_corrupt").alias("text")).alias("error_details")
    )
    head = F.to_json(failure, {"ignoreNullFields": "false"})
    whole = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"original_payload":'), F.coalesce("original", F.lit("null")), F.lit("}"))
    failed = jobs.where("error IS NOT NULL").select("file", F.coalesce("job_id", "stem").alias("name"), whole.alias("json"))
    good = jobs.where("error IS NULL").select("file", "job_id", "created_at", "payload.observations", F.col("payload.current_time_utc").alias("now"), "profile")
    out = None
    for name in sorted(r["profile"] for r in good.select("profile").distinct().collect()):  # two at most
        own = good.where(F.col("profile") == name)
        raw = own.select("file", "now", F.posexplode_outer("observations").alias("idx", "o")).where("o IS NOT NULL").select("file", "now", F.col("idx").cast("long").alias("idx"), "o.*")
        if large is not None:
            more = large.where("json <> 'null'").join(small(own.select("file", "now")), "file")
            raw = raw.unionByName(more.select("file", "now", "idx", F.from_json("json", RAW_OBSERVATION).alias("o")).select("file", "now", "idx", "o.*"))
        done = own.select("file", "job_id", "created_at").join(respond(raw, rules, ["file"], F.col("now"), PROFILES[name], own.select("file")), "file")
        out = done if out is None else out.unionByName(done)
    if out is None:
        return failed.where("false"), failed
    envelope = F.struct("job_id", "created_at", _now().alias("completed_at"), F.lit("completed").alias("status"), F.col("response").alias("result"))
    return out.select("file", F.col("job_id").alias("name"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("json")), failed


def pending(spark: SparkSession, base: str) -> DataFrame:
    """(job, path, modificationTime) of the queue's files that have neither a completed nor a failed record yet."""
    def listed(folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{base}/{folder}").drop("content")
        return files.withColumn("job", F.regexp_extract("path", r"([^/]*)\.json$", 1))

    done = listed("completed").select("job").union(listed("failed").select("job"))
    return listed("pending").join(done, "job", "left_anti").select("job", "path", "modificationTime")


def _literal(path: str) -> str:
    """A path that Spark's readers do not take for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def run(spark: SparkSession, base: str, rules: DataFrame, *, once: bool = True, seconds: int = 5, files: int = 1000) -> StreamingQuery:
    """Works off the queue under base; once: what is pending now, else every so many seconds."""
    ensure(base)

    def batch(rows: DataFrame, batch_id: int) -> None:
        scratch = Scratch(spark)
        try:
            listed = rows.distinct().collect()  # so many files at most
            whole = [r["path"] for r in listed if r["length"] <= pieces.LARGE]
            cut = [r["path"] for r in listed if r["length"] > pieces.LARGE]
            jobs = observations = parts = None
            if whole:
                text = spark.read.text([_literal(p) for p in whole], wholetext=True)
                jobs = scratch.stage(_jobs(text.select("value", F.col("_metadata.file_name").alias("file"))))
            if cut:
                parts = pieces.parts(spark, [_literal(p) for p in cut], "file_name")
                heads, observations = _large_jobs(parts, scratch)
                jobs = heads if jobs is None else jobs.unionByName(heads)
            if jobs is not None:
                completed, failed = process(jobs, rules, observations)
                write_documents(completed, f"{base}/completed")
                if cut:
                    failed, files = scratch.stage(failed), small(heads.select("file"))
                    _write_failed_large(failed.join(files, "file", "left_semi"), observations, parts, f"{base}/failed")
                    failed = failed.join(files, "file", "left_anti")
                write_documents(failed, f"{base}/failed")
        finally:
            scratch.drop()

    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files).load(f"{base}/pending")
    writer = source.select("path", "length").writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

"""A deterministic sharded WARC writer and its reader.

Pages are range-sorted by page_id into shards of about equal size whose bounds follow from the rows alone. A shard's
records are written in order as one gzip member each, and its files roll by compressed size; each file begins with a
warcinfo record. Tasks write under temporary names of their own attempt and list them in a staged manifest; a
task that runs again after a lost executor writes new ones. The commit renames what the staged manifest lists, which may be done
twice, and then puts the manifest of files, sizes and digests in its place. Names and bytes of the archives
depend only on the rows; readers open only what the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, delete, shared_dir, small_batches, table, trimmed

MIN_REVISIT_BYTES, ROLL_BYTES, SHARD_BYTES = 1000, 8 << 20, 24 << 20
#: Shards are larger than SHARD_BYTES where there would be more of them than this (from 1.5 TB on): the driver holds their bounds.
MAX_SHARDS = 1 << 16
#: Buckets of page_ids, in bits, whose sizes are gathered to place the shards' bounds; those too large are cut into as many parts, again and again.
RANGE_BITS, PART_BITS = 12, 4
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _store(uri: str):
    """(file system, path) of a shared folder, for the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, digest, size) -> (page_id, digest, refers_to): for each revisit the page_id of its response.

    Pages with equal payloads are grouped by SHA-1 and size; the largest page_id answers.
    """
    big = pages.where(F.col("size") >= min_bytes)
    first = big.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return big.join(first, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _shards(pages: DataFrame, sizes: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(pages with their shard, how many there are): ranges of page_id, rows without one first, of about shard_bytes each.

    page_ids with equal leading bits are a bucket. Buckets larger than a shard are cut by further bits, until they
    fit or hold one page_id; the rows of such a page_id are dealt by digest. Buckets in order are gathered into shards.
    """
    size = F.sum(F.col("size") + 300)
    lo, hi, total, nulls = sizes.agg(F.min("page_id"), F.max("page_id"), size, F.sum(F.when(F.col("page_id").isNull(), F.col("size") + 300))).first()
    bound = max(shard_bytes, -(-(total or 0) // MAX_SHARDS))
    leaves: list[tuple[int, int, int]] = []  # (bits that are left out, the leading bits, bytes)
    if lo is not None:
        bits = next(b for b in range(65) if (hi >> b) - (lo >> b) < 1 << RANGE_BITS)
        left = sizes.where("page_id IS NOT NULL")
        while True:
            key = F.shiftright("page_id", min(bits, 63)).alias("key")
            found = [(r["key"], r["s"]) for r in left.groupBy(key).agg(size.alias("s")).collect()]
            large = [(k,) for k, s in found if s > bound and bits]
            leaves += [(bits, k, s) for k, s in found if s <= bound or not bits]
            if not large:
                break
            left = left.withColumn("key", key).join(F.broadcast(sizes.sparkSession.createDataFrame(large, "key long")), "key").drop("key")
            bits = max(0, bits - PART_BITS)
    shards, held = 0, nulls or 0
    parts = max(1, -(-held // bound))
    rows = pages.withColumn("shard", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")))
    shards, held = (parts - 1, held) if parts == 1 else (parts, 0)
    placed: dict[int, list[tuple[int, int, int]]] = {}
    for bits, k, s in sorted(leaves, key=lambda leaf: leaf[1] << leaf[0]):
        parts = max(1, -(-s // bound))
        if held and held + s > bound:
            shards, held = shards + 1, 0
        placed.setdefault(bits, []).append((k, shards, parts))
        shards, held = (shards, held + s) if parts == 1 else (shards + parts, 0)
    for bits, found in placed.items():
        of = F.broadcast(sizes.sparkSession.createDataFrame(found, "_key long, _shard int, _parts int"))
        rows = rows.join(of, F.shiftright("page_id", min(bits, 63)) == F.col("_key"), "left")
        rows = rows.withColumn("shard", F.coalesce("shard", F.col("_shard") + F.pmod(F.xxhash64("digest"), F.col("_parts")).cast("int"))).drop("_key", "_shard", "_parts")
    return rows, shards + 1


def _header(value: str | None) -> str:
    """A header's value on one line; control characters, spaces and others that a URI can't hold are percent-encoded."""
    return quote(value or "", safe="!#$%&'()*+,/:;=?@[]~-._")


def _framed(lines: list[str], body: bytes) -> bytes:
    block = f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}"
    return "\r\n".join(["WARC/1.1", *lines, block, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def record(page_id: int | None, n: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record with regenerated headers; n counts rows that share page_id and payload. Its block is an HTTP response, a revisit's the head alone."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    name = lambda page, k: f"<urn:page:{'null' if page is None else page}:{digest}:{k}>"
    revisit = refers_to is not None
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id, n)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is None or _header(url) != url:  # the target as it was, in a form that can be read back
        lines.append("X-Target: none" if url is None else f"X-Target: is {quote(url, safe='')}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}"]
    return _framed(lines, _HTTP.format(len(payload)).encode() + (b"" if revisit else payload))


def file_info(name: str, date: str = DATE) -> bytes:
    """The warcinfo record at the start of a file."""
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _framed(lines, b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")


class _Shard:
    """Files of one shard, under temporary names."""

    def __init__(self, store, folder: str, shard: int, roll_bytes: int):
        self.store, self.folder, self.shard, self.roll = store, folder, shard, roll_bytes
        self.part, self.made = 0, []
        self._open()

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.part:06d}.warc.gz"
        self.temporary = uuid.uuid4().hex
        self.out = self.store.open_output_stream(f"{self.folder}/tmp/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()
        self._put(file_info(self.name))

    @staticmethod
    def _member(raw: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(raw) + c.flush()

    def _put(self, raw: bytes, member: bytes | None = None) -> None:
        member = member or self._member(raw)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def write(self, raw: bytes) -> None:
        member = self._member(raw)
        if self.records and self.bytes + len(member) > self.roll:
            self.close()
            self.part += 1
            self._open()
        self._put(raw, member)
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.made.append((self.name, self.shard, self.records, self.bytes, self.sha.hexdigest(), self.temporary))


def write_archives(pages: DataFrame, uri: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> archives in the new folder uri; returns the committed manifest.

    Payloads are html in UTF-8; null html is an empty payload. Payloads of min_revisit_bytes or
    more that are equal are stored once, by the largest page_id; others refer to it. Rows that
    share page_id and payload are records of their own, in one shard. Rows without page_id come first and are
    responses. A page of any length is one record, held in memory by its task. No rows give an empty manifest.
    """
    spark = small_batches(pages).sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    scratch = Scratch(spark)
    try:
        light = scratch.stage(pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")))
        revisits = decide(light, min_revisit_bytes)
        # decisions travel with the pages through one shuffle and stand right before theirs
        none = F.lit(None)
        rows = pages.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("refers_to")).unionByName(
            revisits.select("page_id", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "refers_to")
        )
        rows, shards = _shards(rows, light, shard_bytes)
        # all rows of a shard meet in one task; a task may get more than one, in order
        rows = rows.select("page_id", "digest", "kind", "url", "payload", "refers_to", "shard")
        rows = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = _store(uri)
            open_: _Shard | None = None
            files: list[tuple] = []
            last, ref, n = None, None, 0
            for b in batches:
                for page_id, digest, kind, url, body, to, at in zip(*(b.column(i) for i in range(7)), strict=True):
                    key = (page_id.as_py(), digest.as_py())
                    if key != last:
                        last, ref, n = key, None, 0
                    if not kind.as_py():
                        ref = to.as_py()
                        continue
                    shard = at.as_py()
                    if open_ is None or open_.shard != shard:
                        if open_ is not None:  # rows are sorted: an earlier shard is over
                            open_.close()
                            files += open_.made
                        open_ = _Shard(store, folder, shard, roll_bytes)
                    open_.write(record(key[0], n, url.as_py(), body.as_py(), key[1], ref))
                    n += 1
            if open_ is not None:
                open_.close()
                files += open_.made
            cols = list(zip(*files, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "shard", "records", "bytes", "sha256", "temporary"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Renames; what an earlier attempt of this has renamed stays."""
            store, folder = _store(uri)
            for b in batches:
                for name, temporary in zip(b.column("file").to_pylist(), b.column("temporary").to_pylist(), strict=True):
                    if not _exists(store, f"{folder}/{name}"):
                        store.move(f"{folder}/tmp/{temporary}", f"{folder}/{name}")
                yield b.drop_columns(["temporary"])

        store, folder = _store(uri)
        store.create_dir(f"{folder}/tmp", recursive=True)
        staged = scratch.stage(rows.mapInArrow(trimmed(run), f"{_MANIFEST}, temporary string"))
        staged.mapInArrow(trimmed(place), _MANIFEST).write.parquet(f"{uri}/manifest-uncommitted")
        store.delete_dir(f"{folder}/tmp")  # what attempts that failed have left
        store.move(f"{folder}/manifest-uncommitted", f"{folder}/manifest")  # the commit
    finally:
        scratch.drop()
    return spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")


def _exists(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


_ID = re.compile(r"<urn:page:(null|-?\d+):")
_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def parse(raw: bytes) -> dict | None:
    """A response or revisit; None for other records. Digests and lengths are computed anew from what the record holds, and compared with its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    digest = lambda data: f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"
    if h["WARC-Block-Digest"] != digest(block):
        raise ValueError(f"block digest of {h['WARC-Record-ID']} differs")
    kind = h["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != length or digest(payload) != h["WARC-Payload-Digest"]):
        raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
    number = lambda key: None if key not in h or (x := _ID.match(h[key])[1]) == "null" else int(x)
    target = h.get("X-Target")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": h["WARC-Target-URI"] if target is None else None if target == "none" else unquote(target.removeprefix("is ")),
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload": payload if kind == "response" else None,
    }


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one record each, without holding the file."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(d.decompress(data))
            data = b""
            if d.eof:
                yield b"".join(out)
                data, d, out = d.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("archive is cut off")


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """Every response and revisit of the files that the manifest lists; a revisit's payload is null, its length and digest those it names."""
    files = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest").select("file")
    fields = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types, strict=True)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        for b in batches:
            for name in b.column("file"):
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name.as_py()}", compression=None) as stream:
                    for raw in members(stream):
                        if (found := parse(raw)) is not None:
                            rows.append(found)
                        held += len(raw)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.repartition(spark.sparkContext.defaultParallelism * 2, "file").mapInArrow(trimmed(run), _READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), uri)
        out = read_archives(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return out.checkpoint()
    finally:
        delete(spark, uri)


ORACLE = r"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
FROM g
"""

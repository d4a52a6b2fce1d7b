"""Large JSON documents as a stream: an array inside a document is read and written element by element, in the memory of a few.

A document of more than LARGE bytes would be one row, and one string, in Spark's own readers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a document from which on its observations are read one by one.
LARGE = 8_000_000

#: idx of the rows of elements() that are no elements: the document without its array's elements, and the mark of one that cannot be read.
HEAD, BROKEN = -1, -2

_STRING = r'"(?:[^"\\]+|\\.)*+"|\'(?:[^\'\\]+|\\.)*+\''
_OUTSIDE = re.compile(rf"{_STRING}|[{{}}\[\]:,\"']", re.S)
_WITHIN = re.compile(rf"{_STRING}|[{{}}\[\]\"']", re.S)
#: A whole object of no more than two levels, which most elements are.
_SHALLOW = re.compile(rf"\{{(?:[^{{}}\[\]\"']++|{_STRING}|\{{(?:[^{{}}\[\]\"']++|{_STRING})*+\}})*+\}}", re.S)
_CLOSES = {"{": "}", "[": "]"}


class Splitter:
    """Takes a document's text in parts; finds the elements of the array at a path of keys, and what is around them.

    A document may be a list of such documents; what follows it is ignored, as Spark's readers do.
    """

    def __init__(self, path: tuple[str, ...]):
        self.path, self.text, self.at = path, "", 0
        self.stack: list[str] = []  # open brackets
        self.keys: list[str | None] = []  # of each open bracket, the key that was read last
        self.key_next = False
        self.string: str | None = None
        self.inside = 0  # depth of the array's own bracket, once it is open
        self.start = 0  # of the element, or of the head's next part
        self.ended: int | None = None  # where an element that has brackets of its own has ended
        self.n = 0
        self.head: list[str] = []
        self.found: list[tuple[int, str]] = []
        self.done = self.broken = self.taken = False

    def feed(self, part: str, last: bool = False) -> list[tuple[int, str]]:
        """(place, text) of the elements that end in this part."""
        if self.broken or self.done:
            return []
        # what was dealt with goes: an element's text stays until it has ended, other text moves to the head
        if not self.inside:
            self.head.append(self.text[self.start : self.at])
            self.start = self.at
        self.text = self.text[self.start :] + part
        self.at -= self.start
        self.ended = None if self.ended is None else self.ended - self.start
        self.start = 0
        while not self.broken and not self.done:
            within = self.inside and len(self.stack) > self.inside
            m = (_WITHIN if within else _OUTSIDE).search(self.text, self.at)
            if m is None:
                self.at = len(self.text)
                break
            token = m.group()
            if token in ('"', "'"):  # a string that goes on in the next part
                self.at = m.start()
                break
            self.at = m.end()
            if token == "{" and self.inside == len(self.stack) > 0 and self.ended is None and (whole := _SHALLOW.match(self.text, m.start())):
                self.at = self.ended = whole.end()
                continue
            self._token(token, m.start())
        self.broken = self.broken or last and not self.done
        out, self.found = self.found, []
        return out

    def rest(self) -> str:
        """The document without the array's elements, once all parts were taken."""
        return "".join([*self.head, self.text[self.start : self.at]])

    def _element(self, end: int, closing: bool) -> None:
        element = self.text[self.start : end].strip()
        if not element and (self.n or not closing) or self.ended is not None and self.text[self.ended : end].strip():
            self.broken = True
        elif element:
            self.found.append((self.n, element))
            self.n += 1
        self.ended = None

    def _token(self, token: str, at: int) -> None:
        depth = len(self.stack)
        if token in "{[":
            listed = 1 if self.stack[:1] == ["["] else 0
            if self.inside == depth and self.ended is not None:
                self.broken = True
            elif token == "[" and not self.inside and not self.taken and tuple(self.keys[listed:]) == self.path and "[" not in self.stack[listed:]:
                self.head.append(self.text[self.start : at + 1])
                self.start, self.inside, self.n, self.taken = at + 1, depth + 1, 0, True
            self.stack.append(token)
            self.keys.append(None)
            self.key_next = token == "{"
        elif token in "}]":
            if not self.stack or _CLOSES[self.stack[-1]] != token:
                self.broken = True
                return
            if self.inside == depth:
                self._element(at, True)
                self.start, self.inside = at, 0
            self.stack.pop()
            self.keys.pop()
            self.key_next = False
            if self.inside == depth - 1 > 0:
                self.ended = at + 1
            self.taken = self.taken and depth > 2  # the next document of a list has an array of its own
            self.done = not self.stack
        elif token == ",":
            if self.inside and depth == self.inside:
                self._element(at, False)
                self.start = at + 1
            self.key_next = bool(self.stack) and self.stack[-1] == "{"
        elif token == ":":
            if self.keys and not self.inside:
                self.keys[-1] = self.string
        elif self.key_next and not self.inside:
            try:
                self.string = json.loads(token if token[0] == '"' else json.dumps(token[1:-1]))
            except ValueError:
                self.string = None
            self.key_next = False


def large(spark: SparkSession, path: str | list[str]) -> bool:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > LARGE).limit(1).count() > 0


def parts(spark: SparkSession, path: str | list[str], named: str = "file_path") -> DataFrame:
    """(file, place, start, nth, size, part) of large documents: their bytes without the closing braces at which they are cut."""
    text = spark.read.option("lineSep", "}").text(path).where(F.col("_metadata.file_size") > LARGE)
    file = F.col(f"_metadata.{named}")
    return text.select(
        file.alias("file"), F.xxhash64(file).alias("place"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("part"),
    )


def in_order(cut: DataFrame) -> DataFrame:
    return cut.repartition("file").sortWithinPartitions("place", "start", "nth")


def elements(cut: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """parts() -> (file, idx, json): a row for each element of the array at path, and one for the HEAD; a BROKEN one if the text is no whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, taken = None, Splitter(path), 0

        def rows(found: list[tuple[int, str]]) -> pa.RecordBatch:
            cols = [pa.array([here] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["file", "idx", "json"])

        def end() -> pa.RecordBatch:
            own.feed("", last=True)
            return rows([(BROKEN, "") if own.broken else (HEAD, own.rest())])

        for b in batches:
            files, texts = b.column("file").to_pylist(), b.column("part").to_pylist()
            at = 0
            while at < len(files):
                if files[at] != here:
                    if here is not None:
                        yield end()
                    here, own, taken = files[at], Splitter(path), 0
                to = at
                while to < len(files) and files[to] == here:
                    to += 1
                text = b"}".join(texts[at:to]) + b"}"
                taken += len(text)
                if taken == b.column("size")[at].as_py() + 1:  # the file's end is no brace
                    text = text[:-1]
                try:
                    yield rows(own.feed(text.decode()))
                except UnicodeDecodeError:
                    own.broken = True
                at = to
        if here is not None:
            yield end()

    return in_order(cut).select("file", "size", "part").mapInArrow(run, "file string, idx long, json string")

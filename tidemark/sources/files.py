"""Single files in any folder that pyarrow's file systems open: written under a temporary name and renamed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def put(at: fs.FileSystem, folder: str, name: str, data: bytes) -> None:
    """A reader sees the whole file or none. What has the name already is replaced, so that a task may run again."""
    temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    _named(at, temporary, f"{folder}/{name}")


def _named(at: fs.FileSystem, temporary: str, path: str) -> None:
    if not isinstance(at, fs.LocalFileSystem) and at.get_file_info(path).type != fs.FileType.NotFound:
        at.delete_file(path)
    at.move(temporary, path)


class Opened:
    """One file that is written in parts; close() gives it its name, as put() does."""

    def __init__(self, at: fs.FileSystem, folder: str, name: str):
        self.at, self.folder, self.name = at, folder, name
        self.temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out = at.open_output_stream(self.temporary, compression=None)

    def close(self) -> None:
        self.out.close()
        _named(self.at, self.temporary, f"{self.folder}/{self.name}")


def file_name(job_id: str) -> str:
    return f"{quote(job_id, safe=' ')}.json"


def document(value: object) -> bytes:
    return (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()


def write_documents(rows: DataFrame, uri: str) -> int:
    """rows (name, json) -> a file for each row, written by the tasks; how many there are."""
    at, folder = store(uri)
    at.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folder = store(uri)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                put(at, folder, file_name(name), document(json.loads(text)))
            yield b.select([0])

    return rows.select("name", "json").mapInArrow(run, "name string").count()


def write_in_parts(rows: DataFrame, uri: str, *order: str) -> int:
    """rows (name, part, and the columns of order) -> a file for each name, its parts in order, one held at a time; how many there are."""
    at, folder = store(uri)
    at.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folder = store(uri)
        here, opened = None, None
        for b in batches:
            done = []
            for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != here or opened is None:
                    if opened is not None:
                        opened.close()
                        done.append(here)
                    here, opened = name, Opened(at, folder, file_name(name))
                opened.out.write(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["name"])
        if opened is not None:
            opened.close()
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.string())], names=["name"])

    rows = rows.repartition("name").sortWithinPartitions("name", *order).select("name", "part")
    return rows.mapInArrow(run, "name string").count()

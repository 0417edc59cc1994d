"""Small files in stores that tasks reach by themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from lettermill.session import ship


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one for a plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def read_bytes(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path) as source:
        return source.read()


def write_whole(uri: str, content: bytes) -> None:
    """Write a file that appears at once, so no reader ever finds a part of it;
    a repeated task replaces it by its like."""
    store, path = open_store(uri)
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    try:
        out = store.open_output_stream(draft)
    except FileNotFoundError:  # the first file of a folder
        store.create_dir(folder, recursive=True)
        out = store.open_output_stream(draft)
    with out:
        out.write(content)
    store.move(draft, path)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file in ``folder`` for each row (``name``, ``content``), written by the
    tasks; equal names must have equal contents."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                write_whole(f"{folder}/{name}", content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    ship(rows.sparkSession)
    rows.select("name", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def files_below(uri: str) -> list[tuple[str, int]]:
    """``(uri, bytes)`` of the files below a folder (or of the file itself), in
    order, without those whose name begins with a dot or an underscore."""
    uri = uri.rstrip("/")
    store, path = open_store(uri)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in ("_", ".")]
    return sorted((uri[: len(uri) - len(path)] + f.path if uri.endswith(path) else f.path, f.size) for f in shown)

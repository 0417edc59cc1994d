"""Attachment payloads, read only after the gate has let their names pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from lettermill.operators.privacy import gate
from lettermill.session import ship


def read_file(path: str) -> bytes:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(inner) as source:
        return source.read()


def payloads(metadata: DataFrame, read: Callable[[str], bytes] = read_file, path: str = "path", useful: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(stored, held_back)``: the kept attachments with their ``payload``, and
    the metadata of the others, whose files are never opened. A filter on
    ``binaryFile`` promises no such thing, so each task opens its survivors."""
    kept, held_back = gate(metadata, useful)
    kept = kept.drop("payload")
    ship(metadata.sparkSession)
    schema = StructType([*kept.schema.fields, StructField("payload", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one payload in memory at a time
                row = batch.slice(k, 1)
                blob = read(row.column(row.schema.get_field_index(path))[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([blob], pa.binary())], schema.names)

    return kept.mapInArrow(run, schema), held_back

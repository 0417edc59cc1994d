"""Exact substring de-duplication over bytes by a run-length index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lettermill.llm import textbytes as tb
from lettermill.llm import winnow
from lettermill.llm.runindex import RunLengthIndex

LENGTH = 400
GRAM = 100
INDEX_BYTES = 1 << 20
BYTES = winnow.Kind(lambda data, off: (None, None, off), lambda data, starts, ends: tb.BYTE_CODE[data])


def index_block(data: np.ndarray, sym: np.ndarray, edge: np.ndarray, anchor: np.ndarray, ident: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes of a block's segments start elsewhere
    in the block too. Segments of one anchor always share an index, whose size
    is held near ``INDEX_BYTES``."""
    out = np.zeros(len(data), bool)
    order = np.argsort(anchor, kind="stable")
    size = np.diff(edge)[order]
    last = np.r_[anchor[order][1:] != anchor[order][:-1], True]
    begin = 0
    for k in np.flatnonzero(last).tolist():
        if (total := int(size[begin : k + 1].sum())) < INDEX_BYTES and k + 1 < len(order):
            continue
        rows, n = order[begin : k + 1], size[begin : k + 1]
        place = np.repeat(edge[rows] - (np.cumsum(n) - n), n) + np.arange(total)
        out[place] = RunLengthIndex(data[place], np.r_[0, np.cumsum(n)], length).stream(length)
        begin = k + 1
    return out


def remove_repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept_bytes``, ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256``; columns of those names are replaced.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; strings are judged on the
    input. The corpus is cut into blocks by content (see ``winnow``). Each block
    is indexed by its run-length compressed transform with samples at the ends
    of runs; all of its texts are streamed through it, and where their matching
    statistics reach ``length`` they are marked.

    Null texts are empty; rows of equal or null id are documents like others,
    repeated rows repeat each other's strings, and ties need no order; whole
    copies of at least ``length`` bytes lose everything. Very long texts are
    listed in overlapping pieces. Other columns are kept whatever their names.
    An empty table gives an empty result.
    """
    new = {"kept_bytes": BinaryType(), "n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept_sha256": StringType()}
    docs = docs.drop(*new)
    rows, names = winnow.aside(docs, text, ident)
    joined = winnow.with_stretches(rows, winnow.repeated_windows(rows, BYTES, length, gram, False, index_block))
    schema = StructType([*docs.schema.fields, *(StructField(k, t) for k, t in new.items())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            n = np.diff(off)
            gone = winnow.covered(part.column(part.schema.get_field_index("cut")), off)
            # a removed run begins at a text's first byte or behind a kept one
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            heads = off[:-1][n > 0]
            fresh[heads] = gone[heads]
            spans = np.diff(np.searchsorted(np.flatnonzero(fresh), off))
            raw = data[~gone].tobytes()
            edge = off - np.searchsorted(np.flatnonzero(gone), off)
            kept = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            values = [pa.array(kept, pa.binary()), pa.array(n), pa.array(n - np.diff(edge)), pa.array(spans),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*winnow.back(part, names, text), *values], schema.names)

    return tb.map_arrow(joined, finish, schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as x, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as m from (select doc_id, h, unnest(range(0, n - 399)) as i from d)),
often as (select m from win group by m having count(*) > 1),
hit as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from win where m in (from often)),
isle as (select *, sum(case when before is null or i > before + 400 then 1 else 0 end) over (partition by doc_id order by i) as k from hit),
span as (select doc_id, min(i) as a, max(i) + 400 as b from isle group by doc_id, k),
gap as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from span
  union all select doc_id, max(b), null from span group by doc_id),
kept as (
  select d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' order by a) as k from gap join d using (doc_id) group by d.doc_id),
total as (select doc_id, sum(b - a) as gone, count(*) as spans from span group by doc_id)
select d.doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join total using (doc_id) left join kept using (doc_id)
"""

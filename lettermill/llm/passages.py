"""Passage de-duplication by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lettermill.llm import relative, winnow
from lettermill.llm import textbytes as tb

WINDOW = 50
GRAM = 8
WORDS = winnow.Kind(tb.word_spans, tb.word_hashes)


def parse_block(data: np.ndarray | None, sym: np.ndarray, edge: np.ndarray, anchor: np.ndarray, ident: np.ndarray, length: int) -> np.ndarray:
    """Each run of a block, factored against the runs of smaller ids."""
    return relative.repeated_starts(sym, edge, ident, length)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words``, ``n_removed`` and
    ``kept_sha256``; columns of those names are replaced.

    A word goes if a window of ``window`` words that covers it also starts in a
    document of smaller id. The corpus is cut by content into reference blocks
    of runs that share anchors (see ``winnow``). Each block is indexed over its
    words, and each run is factored greedily against the runs of smaller ids:
    factors of ``window`` words or more are duplicates, and so are windows over
    the boundary of two factors that are found when checked. Words are compared
    by their 64-bit hashes, one by one.

    Null texts have no words; a null id is smaller than any other; rows of
    equal id never remove each other's words, so repeated rows with one id
    stay, and ties need no order. Whole copies are removed but for those of the
    smallest id. Very long texts are listed in overlapping pieces. Other
    columns are kept whatever their names. An empty table gives an empty result.
    """
    new = {"kept_text": StringType(), "n_words": LongType(), "n_removed": LongType(), "kept_sha256": StringType()}
    docs = docs.drop(*new)
    rows, names = winnow.aside(docs, text, ident)
    joined = winnow.with_stretches(rows, winnow.repeated_windows(rows, WORDS, window, gram, True, parse_block))
    schema = StructType([*docs.schema.fields, *(StructField(k, t) for k, t in new.items())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            starts, ends, first = tb.word_spans(data, off)
            gone = winnow.covered(part.column(part.schema.get_field_index("cut")), first)
            n = np.diff(first)
            keep = np.flatnonzero(~gone)
            norm, _, stop = tb.joined(data, starts[keep], ends[keep])
            edge = np.r_[0, stop + 1][np.searchsorted(keep, first)]
            raw = norm.tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            removed = n - np.diff(np.searchsorted(keep, first))
            values = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*winnow.back(part, names, text), *values], schema.names)

    return tb.map_arrow(joined, finish, schema)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), chr(1))) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
least as (select h, min(doc_id) as lo from win group by h),
hit as (select win.doc_id, list(distinct i) as starts from win join least using (h) where lo < win.doc_id group by win.doc_id),
gone as (
  select distinct doc_id, s + k as j from (select doc_id, unnest(starts) as s from hit), range(50) t(k)),
kept as (
  select doc_id, j, x from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as j from d) e
  where not exists (from gone where gone.doc_id = e.doc_id and gone.j = e.j)),
told as (select doc_id, string_agg(x, ' ' order by j) as k, count(*) as n from kept group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join told using (doc_id)
"""

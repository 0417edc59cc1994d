"""Texts of an Arrow batch as one byte array, and vectorised work on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lettermill.session import ship

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Any ASCII byte but letters and digits parts terms.
NO_TERM = np.arange(256) < 128
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
RATIO = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * RATIO)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of the texts in them (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``most`` bytes of text at most (one
    longer text is a part by itself), each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ``space``, by default ASCII
    white space; none crosses texts), and the n+1 positions of the texts in the list of words."""
    solid = ~space[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    begin[off[:-1][full]] = solid[off[:-1][full]]
    end[off[1:][full] - 1] = solid[off[1:][full] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: the bytes, and the words' starts and ends."""
    lens = ends - starts
    to = np.cumsum(lens + 1) - lens - 1
    out = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    n = int(lens.sum())
    within = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
    taken = data[np.repeat(starts, lens) + within]
    out[np.repeat(to, lens) + within] = LOWER[taken] if lower else taken
    return out, to, to + lens


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    taken = data[np.repeat(starts, lens) + within]
    if lower:
        taken = LOWER[taken]
    powers = np.cumprod(np.full(int(lens.max()), RATIO, np.uint64))
    return mix64(np.add.reduceat(BYTE_CODE[taken] * powers[within], first) + lens.astype(np.uint64))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, x = 1, x.copy()
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) from sorted batches,
    none of which ends inside a group of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cut = table.num_rows
        change = np.zeros(cut - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            held, rows, least = [*table.to_batches()], cut, 2 * cut
            continue
        cut = int(at[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges (x, y): the smallest node of each one's component."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return label


def group_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside each run of equal ``group``, shift by shift."""
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        yield at, at + step
        step += 1


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)

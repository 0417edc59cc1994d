"""Finding equal windows across a corpus through content-defined anchors.

A window is ``length`` consecutive symbols. Its anchor is the gram of ``gram``
symbols in it with the smallest hash (the leftmost of equals), so equal windows
have equal anchors, and a corpus needs about one anchor for each half window.
Consecutive windows that share an anchor are a run; each window is in exactly
one. Only runs whose anchor also stands in a run of another content can hold a
window that is repeated without its whole run, so only these travel: to the
block of their anchor, where an index of the block finds what is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm import textbytes as tb
from lettermill.llm.joins import with_facts
from lettermill.session import durable, durable_buckets, ship, shuffle_partitions

GROUP_RUNS = 256
SALTS = 8  # groups of leftover windows for each block of a split anchor
BUCKET_RUNS = 2048
U64 = np.uint64
NULL_ID = -(2**63)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive symbols, by doubling."""
    if len(x) < n:
        return np.zeros(0, U64)
    m, out, at, size, f = len(x) - n + 1, None, 0, 1, x
    power = np.array([tb.RATIO])  # an array wraps around silently
    while True:
        if n & size:
            out = f[:m].copy() if out is None else out * power + f[at : at + m]
            at += size
        if at == n:
            return tb.mix64(out)
        f = f[:-size] * power + f[size:]
        power = power * power
        size *= 2


@dataclass
class Runs:
    """Runs of windows of some texts: owning text, first window in it, number
    of windows, hash of the anchor; and where each run's first window lies."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    at: np.ndarray


def runs_of(symbols: np.ndarray, off: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of texts of less than 2**28 symbols together."""
    g = grams(symbols, gram)
    if len(symbols) < length:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U64), np.zeros(0, np.int64))
    low = U64((1 << 28) - 1)
    best = tb.window_min((g & ~low) | np.arange(len(g), dtype=U64), length - gram + 1) & low
    n = np.maximum(np.diff(off) - length + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(off[:-1] - (np.cumsum(n) - n), n) + np.arange(len(text))
    pos = best[start].astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])]) if len(pos) else np.zeros(0, np.int64)
    t = text[begin]
    return Runs(t, start[begin] - off[t], np.diff(np.r_[begin, len(pos)]), g[pos[begin]], start[begin])


@dataclass(frozen=True)
class Kind:
    """What a symbol is: ``edges`` finds the symbols of some texts (starts and
    ends in the bytes, and the texts' n+1 positions among them; starts are None
    if each byte is one), ``codes`` hashes some of them. A text of more than
    ``piece`` symbols is read in pieces."""

    edges: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray | None, np.ndarray | None, np.ndarray]]
    codes: Callable[[np.ndarray, np.ndarray | None, np.ndarray | None], np.ndarray]
    piece: int = 1 << 20

    def pieces(self, data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Symbols, offsets and place of the first one. A text of more than
        ``piece`` symbols comes in overlapping pieces: each window lies in
        exactly one."""
        starts, ends, first = self.edges(data, off)
        cut = lambda x, a, b: None if x is None else x[a:b]
        if len(first) != 2 or first[-1] <= self.piece + length:
            yield self.codes(data, starts, ends), first, 0
            return
        n = int(first[-1])
        for a in range(0, n - length + 1, self.piece):
            b = min(a + self.piece + length - 1, n)
            part = self.codes(data[a:b] if starts is None else data, cut(starts, a, b), cut(ends, a, b))
            yield part, np.array([0, b - a]), a


def aside(docs: DataFrame, text: str, ident: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``docs`` under names that can't clash, with ``uid`` (a number of the
    row), ``id`` (null: the smallest long) and ``body``, dealt into buckets by
    ``uid``; and (new, old) names."""
    ship(docs.sparkSession)
    names = [(f"c{k}", c) for k, c in enumerate(docs.columns)]
    rest = [docs[c].alias(n) for n, c in names if c != text]
    rows = docs.select(*rest, F.coalesce(docs[ident].cast("long"), F.lit(NULL_ID)).alias("id"), docs[text].alias("body"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    return durable_buckets(rows, "texts", "uid"), names


def back(part: pa.RecordBatch, names: list[tuple[str, str]], text: str) -> list[pa.Array]:
    """The columns that ``aside`` renamed, in their order."""
    return [part.column(part.schema.get_field_index("body" if old == text else new)) for new, old in names]


SENT = ["bucket", "anchor", "content", "shares", "uid", "id", "first", "blob"]
STRETCH = "uid long, a long, b long"
STRETCH_OR_OPEN = STRETCH + ", anchor long, salt long, blob binary"
RECORD = np.dtype([("print", U64), ("id", np.int64), ("uid", np.int64), ("pos", np.int64), ("many", np.int64)])


def repeated_windows(rows: DataFrame, kind: Kind, length: int, gram: int, earlier: bool, block: Callable) -> DataFrame:
    """``(uid, a, b)``: stretches of symbols covered by windows that occur
    elsewhere too (``earlier``: in a text of smaller id).

    ``rows`` comes from ``aside``. Runs are listed without their text and
    joined with what is known of their content (how often, smallest id) and
    anchor (how many contents). A run whose whole content occurs elsewhere is
    a stretch at once, and of its kind only one place (``earlier``: those of
    the smallest id) is sent on. Runs of an anchor with several contents go, as
    bytes, to the block of their anchor, and ``block`` tells which windows of
    which runs are repeated. The runs of an anchor with more than
    ``GROUP_RUNS`` contents are dealt over several blocks; what these leave
    undecided meets once more, one window of each kind from each block, dealt
    by the window's hash. So no block grows with the corpus. All joins are on
    exchanged tables, where AQE may split a hot key.
    """
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            uid, ident = part.column(0).to_numpy(), part.column(1).to_numpy()
            for sym, edge, base in kind.pieces(data, off, length):
                runs, prints = runs_of(sym, edge, length, gram), grams(sym, length)
                # a run has fewer windows than a window has symbols, so its first and last window hold it all
                ends = prints[runs.at] * tb.RATIO + prints[runs.at + runs.count - 1] if len(runs.at) else np.zeros(0, U64)
                content = tb.mix64(ends + runs.count.astype(U64)) ^ runs.anchor
                columns = (uid[runs.text], ident[runs.text], runs.first + base, runs.count, runs.anchor.view(np.int64), content.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "id", "first", "n", "anchor", "content"])

    runs = durable(tb.map_arrow(rows.select("uid", "id", "body"), listed, "uid long, id long, first long, n long, anchor long, content long"), "runs")
    found = runs.groupBy("anchor", "content").agg(F.count("*").alias("places"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("uid").alias("one"))
    found = durable(found, "contents")
    shared = found.groupBy("anchor").agg(F.count("*").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("m > 1")
    shared = shared.where("lo < hi") if earlier else shared
    known = with_facts(found, shared.select("anchor", "m"), "anchor", "m", found.count(), "content")
    known = known.where(F.col("m").isNotNull() | (F.expr("lo < hi") if earlier else F.expr("places > 1")))
    known = durable(known.select("content", "places", "lo", "one", "m"), "known")
    n_sent = known.where("m is not null").count()
    buckets = max(parts, -(-n_sent // BUCKET_RUNS))

    marked = with_facts(runs, known, "content", "places", runs.count(), "uid").where("places is not null")  # a content has one anchor
    whole = marked.where("id > lo" if earlier else "places > 1").select("uid", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + length).alias("b"))
    one = F.col("id") == F.col("lo") if earlier else F.col("uid") == F.col("one")
    wanted = marked.where(F.col("m").isNotNull() & one).groupBy("uid").agg(F.collect_list(F.struct("first", "n", "anchor", "content", "m")).alias("runs"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            starts, ends, edge = kind.edges(data, off)
            lens = np.diff(np.asarray(part.column(3).offsets))
            flat = part.column(3).flatten()
            first, n, anchor, content, m = (flat.field(c).to_numpy() for c in ("first", "n", "anchor", "content", "m"))
            text = np.repeat(np.arange(part.num_rows), lens)
            if not earlier:  # one place of a content will do
                once = np.unique(content ^ tb.mix64(text).view(np.int64), return_index=True)[1]
                first, n, anchor, content, m, text = (x[once] for x in (first, n, anchor, content, m, text))
            shares = -(-m // GROUP_RUNS)
            sub = tb.mix64(content.view(U64)) % shares.astype(U64)
            bucket = (tb.mix64(anchor.view(U64) + sub * tb.RATIO) % U64(buckets)).astype(np.int64)
            at = edge[text] + first
            a, b = (at, at + n + length - 1) if starts is None else (starts[at], ends[at + n + length - 2])
            blobs = [data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [bucket, anchor, content, shares, part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], first]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], SENT)

    sent = tb.map_arrow(rows.select("uid", "id", "body").join(wanted.hint("shuffle_hash"), "uid"), send,
        ", ".join(f"{c} {'binary' if c == 'blob' else 'long'}" for c in SENT))

    def meet(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in SENT[:-1]}
        blobs = table.column("blob").combine_chunks()
        off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
        data = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]]
        starts, ends, edge = kind.edges(data, off - off[0])
        sym = kind.codes(data, starts, ends)
        # runs of equal content and id are alike, and one of them is indexed
        _, once, like = np.unique(column["content"] ^ tb.mix64(column["id"].view(U64)).view(np.int64), return_index=True, return_inverse=True)
        n = np.diff(edge)[once]
        mine = np.repeat(edge[once] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        some = block(data[mine] if starts is None else None, sym[mine], np.r_[0, np.cumsum(n)], column["anchor"][once], column["id"][once], length)
        n = np.diff(edge)
        place = np.r_[0, np.cumsum(n[once])][like]
        dup = some[np.repeat(place - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]  # for each symbol whether the window from it is repeated
        windows = np.maximum(np.diff(edge) - length + 1, 0)
        row = np.repeat(np.arange(len(windows)), windows)
        at = np.repeat(edge[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(len(row))
        pos = column["first"][row] + at - edge[row]
        out = stretches(column["uid"][row][dup[at]], pos[dup[at]], length)
        none = pa.nulls(out.num_rows, pa.int64())
        out = out.append_column("anchor", none).append_column("salt", none).append_column("blob", pa.nulls(out.num_rows, pa.binary()))
        # windows of a split anchor may also stand in another block
        open_ = column["shares"][row] > 1
        if earlier:
            open_ &= ~dup[at]
        if not open_.any():
            return out
        row, at, pos = row[open_], at[open_], pos[open_]
        prints, anchor = grams(sym, length)[at], column["anchor"][row]
        # one of a kind speaks for all that are decided: if there are several, or no id can be smaller
        alone = (column["id"][row] != NULL_ID) & earlier
        once = np.r_[np.flatnonzero(alone), np.flatnonzero(~alone)[np.unique((prints ^ tb.mix64(anchor.view(U64)))[~alone], return_index=True)[1]]]
        if len(once) < len(row):
            row, at, pos, prints, anchor = (x[once] for x in (row, at, pos, prints, anchor))
        record = np.zeros(len(row), RECORD)
        for name, values in (("print", prints), ("id", column["id"][row]), ("uid", column["uid"][row]), ("pos", pos), ("many", dup[at])):
            record[name] = values
        salt = (tb.mix64(prints) % (SALTS * column["shares"][row]).astype(U64)).astype(np.int64)
        by = np.lexsort((salt, anchor))
        record, anchor, salt = record[by], anchor[by], salt[by]
        begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
        packed = [record[a:b].tobytes() for a, b in zip(begin.tolist(), np.r_[begin[1:], len(record)].tolist(), strict=True)]
        zero = pa.array(np.zeros(len(begin), np.int64))
        return pa.concat_tables([out, pa.table({"uid": zero, "a": zero, "b": zero, "anchor": anchor[begin], "salt": salt[begin],
            "blob": pa.array(packed, pa.binary())})])

    met = durable(sent.groupBy("bucket").applyInArrow(meet, STRETCH_OR_OPEN), "windows")

    def settle(table: pa.Table) -> pa.Table:
        got = np.concatenate([np.frombuffer(b.as_buffer(), RECORD) for b in table.column("blob")])
        dup = decide(got["print"], got["id"], got["many"], earlier)
        hit = got[dup if earlier else dup & (got["many"] == 0)]
        return stretches(hit["uid"], hit["pos"], length)

    late = met.where("blob is not null").groupBy("anchor", "salt").applyInArrow(settle, STRETCH)
    return whole.unionByName(met.where("blob is null").select("uid", "a", "b")).unionByName(late)


def decide(prints: np.ndarray, ident: np.ndarray, many: np.ndarray, earlier: bool) -> np.ndarray:
    """For each window: whether an equal one has a smaller id, or (not
    ``earlier``) whether there is an equal one."""
    order = np.lexsort((ident, prints))
    p, i, m = prints[order], ident[order], many[order]
    out = np.zeros(len(p), bool)
    if len(p):
        new = np.r_[True, p[1:] != p[:-1]]
        begin, which = np.flatnonzero(new), np.cumsum(new) - 1
        out[order] = i > i[begin][which] if earlier else (np.add.reduceat(1 + m, begin) > 1)[which]
    return out


def stretches(uid: np.ndarray, pos: np.ndarray, length: int) -> pa.Table:
    """Windows that follow each other, as stretches of symbols."""
    order = np.lexsort((pos, uid))
    uid, pos = uid[order], pos[order]
    new = np.r_[True, (uid[1:] != uid[:-1]) | (pos[1:] > pos[:-1] + length)] if len(pos) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(pos)] - 1 if len(begin) else begin
    return pa.table({"uid": uid[begin], "a": pos[begin], "b": pos[last] + length})


def with_stretches(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``cut``, the stretches found in each."""
    cut = found.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("cut"))
    return rows.join(cut.hint("shuffle_hash"), "uid", "left")


def covered(column: pa.Array, edge: np.ndarray) -> np.ndarray:
    """Which symbols of a chunk's texts the stretches in ``cut`` cover."""
    lens = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    base = np.repeat(edge[:-1], np.where(np.asarray(column.is_null()), 0, lens))
    flat = column.flatten()
    gone = np.zeros(int(edge[-1]), bool)
    for a, b in zip((base + flat.field("a").to_numpy()).tolist(), (base + flat.field("b").to_numpy()).tolist(), strict=True):
        gone[a:b] = True
    return gone

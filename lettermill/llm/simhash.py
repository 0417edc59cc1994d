"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.llm import textbytes as tb
from lettermill.llm import winnow
from lettermill.llm.joins import with_facts
from lettermill.operators.components import connected_components
from lettermill.session import durable

SEED = 42
SHINGLE = 3
DISTANCE = 3
GROUP_ROWS = 512
PIVOTS = 4
PAIRS = 1 << 20
EMPTY = 255


# The five primes of XXH64
P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
P4, P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every slice of ``data``, all slices a step on at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    size, at = (ends - starts).astype(np.uint64), starts.copy()
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(at), s + P5)
        long_ = np.flatnonzero(size >= 32)
        if len(long_):
            acc = [np.full(len(long_), v) for v in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(long_))
            while len(live):
                k = long_[live]
                for lane in range(4):
                    acc[lane][live] = _round(acc[lane][live], eight[at[k] + 8 * lane])
                at[k] += 32
                live = live[at[k] + 32 <= ends[k]]
            whole = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                whole = (whole ^ _round(np.zeros(1, np.uint64), a)) * P1 + P4
            h[long_] = whole
        h += size
        live = np.flatnonzero(at + 8 <= ends)
        while len(live):
            h[live] = _turn(h[live] ^ _round(np.zeros(1, np.uint64), eight[at[live]]), 27) * P1 + P4
            at[live] += 8
            live = live[at[live] + 8 <= ends[live]]
        live = np.flatnonzero(at + 4 <= ends)
        h[live] = _turn(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero(at < ends)
        while len(live):
            h[live] = _turn(h[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            live = live[at[live] < ends[live]]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned fingerprint of each text."""
    starts, ends, first = tb.word_spans(data, off)
    norm, starts, ends = tb.joined(data, starts, ends, lower=True)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    head = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(doc))
    last = np.minimum(head + shingle, np.repeat(first[1:], n)) - 1
    return majority(xxh64(norm, starts[head], ends[last]), doc, len(n))


def with_fingerprint(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with ``fp``, the fingerprint of ``body`` as a (signed) long, in
    place of that."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = rows.select(*[c for c in rows.columns if c != "body"], "body")
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            fp = fingerprints(data, off, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], schema.names)

    return tb.map_arrow(rows, run, schema)


@dataclass(frozen=True)
class Ring:
    """Segments of a fingerprint's 64 bits, in a ring, and the distance to find.

    Pigeonring: two values within ``distance`` bits have a segment from which
    every chain of l segments differs in at most l * distance / m bits. Of one
    segment that is none, and of two it must be one at most.
    """

    widths: tuple[int, ...]
    distance: int

    def __post_init__(self):
        if sum(self.widths) != 64 or self.budget(1) != 0 or self.budget(2) != 1:
            raise ValueError("segments must fill 64 bits, and chains of one and two allow 0 and 1 bits")

    def budget(self, chain: int) -> int:
        return chain * self.distance // len(self.widths)

    def start(self, i: int) -> int:
        return sum(self.widths[:i])

    def reach(self, i: int, chain: int) -> int:
        """Bits of the chain from segment i on."""
        return sum((self.widths * 2)[i : i + chain])


RING = Ring((16, 16, 16, 16), DISTANCE)


def in_chunks(listed: DataFrame, group_rows: int | None = None) -> DataFrame:
    """``listed`` rows that share their ``key`` with others, dealt and sorted by
    ``(key, x, y)``: lists longer than ``group_rows`` are cut into chunks, and
    each pair of chunks is a group of its own, so no task meets an unbounded
    list. Nodes are distinct fingerprints and agree in half of their bits
    there, so a list is no longer than chance and small edits make it."""
    group_rows = group_rows or GROUP_ROWS
    names = listed.columns
    met = listed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    parts = F.ceil(F.col("n") / group_rows)
    met = met.select(*names, parts.alias("c"), F.pmod(F.xxhash64("node"), parts).alias("m"))
    met = met.select(*names, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("o"))
    met = met.select(*names, F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"))
    return met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def ring_links(values: DataFrame, group_rows: int | None = None, ring: Ring = RING) -> DataFrame:
    """``node, fp`` (longs; the node is ``fp`` if there is no such column) ->
    edges ``(a, b)`` that connect all nodes whose values link.

    The first two chains of the ring are a lookup: each value is listed under
    its own two segments at each place, and visits the lists whose second
    segment is one bit off. Longer chains are tested in the list, before the
    full distance. Each group of ``in_chunks`` returns a spanning forest of its
    links, never all pairs.
    """
    m = len(ring.widths)
    places = [(i, ring.start(i), 64 - ring.reach(i, 2), flip) for i in range(m) for flip in (0, *(1 << k for k in range(ring.widths[(i + 1) % m])))]
    place = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(o).alias("o"), F.lit(s).alias("s"),
        F.lit(f).cast("long").alias("f")) for i, o, s, f in places])).alias("p")
    node = F.col("node") if "node" in values.columns else F.col("fp").alias("node")
    listed = values.select("fp", node, place).select("fp", "node", "p.*")
    turned = F.expr("case when o = 0 then fp else shiftleft(fp, o) | shiftrightunsigned(fp, 64 - o) end")
    key = F.expr("shiftleft(i, 40)").bitwiseOR(F.expr("shiftrightunsigned(turned, s)").bitwiseXOR(F.col("f")))
    listed = listed.withColumn("turned", turned).select("fp", "node", key.alias("key"))
    met = in_chunks(listed, group_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tb.whole_groups(batches, ["key", "x", "y"]):
            a, b = linked(*(table.column(c).to_numpy() for c in ("fp", "node", "key", "x", "y")), ring)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tb.map_arrow(met, run, "a long, b long")


def linked(fp: np.ndarray, node: np.ndarray, key: np.ndarray, x: np.ndarray, y: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each group of equal (key, x, y), sorted by it."""
    if not len(fp):
        return node, node
    m = len(ring.widths)
    group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    at = key >> 40
    v = fp.view(np.uint64)
    turn = np.array([ring.start(i) for i in range(m)], np.uint64)[at]
    back = (np.uint64(64) - turn) & np.uint64(63)
    turned = np.where(turn == 0, v, (v << turn) | (v >> back))
    rest = np.array([[64 - ring.reach(i, chain) for chain in range(m + 1)] for i in range(m)], np.uint64)[at]
    home = (turned >> rest[:, 2]) == (key & ((1 << 40) - 1)).astype(np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
        label = tb.spanning(i, j, len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return moved, label[moved], label

    for i, j in tb.group_pairs(group):
        ok = (home[i] | home[j]) & (node[i] != node[j])
        i, j = i[ok], j[ok]
        d = turned[i] ^ turned[j]
        for chain in range(3, m):  # chains of one and two hold by the key
            ok = np.bitwise_count(d >> rest[i, chain]) <= ring.budget(chain)
            i, j, d = i[ok], j[ok], d[ok]
        ok = np.bitwise_count(d) <= ring.distance
        i, j = i[ok], j[ok]
        if len(i):
            held.append((i, j))
            size += len(i)
        if size >= PAIRS:
            held = [reduced()[:2]]
            size = len(held[0][0])
    moved, to, _ = reduced()
    ok = node[moved] != node[to]
    return node[moved[ok]], node[to[ok]]


def fingerprint_components(prints: DataFrame, ident: str = "id") -> DataFrame:
    """``(fp, component_id, rows)``: the smallest id reachable from each
    fingerprint, and how many rows have it."""
    least = durable(prints.groupBy("fp").agg(F.min(ident).alias("least"), F.count("*").alias("rows")), "fingerprints")
    parts = connected_components(ring_links(least.select("fp")))
    named = least.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    end = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(end, "component").select("fp", "component_id", "rows")


def fingerprinted(docs: DataFrame, text: str, ident: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` under names c0, c1, ... with ``key`` (a hash of the text) and
    ``at``, and a narrow table ``(key, id, fp)`` of the same rows."""
    key = F.md5(F.coalesce(docs[text], F.lit("")))
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], key.alias("key"), F.monotonically_increasing_id().alias("at"))
    prints = with_fingerprint(docs.select(key.alias("key"), docs[ident].alias("id"), docs[text].alias("body")), shingle)
    return rows, durable(prints, "fingerprints")


def simhash_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    A-Z are lower-cased; the shingles are every ``shingle`` consecutive words,
    repeats counted. Fewer words give one shingle of all; no word (null, empty
    or blank text) gives fingerprint zero, which links like any other. Rows
    link at 3 or fewer differing bits; ``component_id`` is the smallest id
    reachable (null if the group has no id), so ties need no order. Equal
    fingerprints are one node of the graph, so repeated rows cost nothing. Very
    long texts are read whole. Only ids, hashes of the texts and fingerprints
    are written; these are joined by the text's hash, a hot text apart. Columns
    named as the results are replaced, others kept whatever their names; an
    empty table gives an empty result.
    """
    docs = docs.drop("fingerprint", "component_id")
    rows, prints = fingerprinted(docs, text, ident, shingle)
    n = prints.count()
    texts = prints.groupBy("key").agg(F.min("fp").alias("fp"), F.count("*").alias("copies"))
    texts = with_facts(texts, durable(fingerprint_components(prints), "groups"), "fp", "rows", n, "key")
    out = with_facts(rows, durable(texts.select("key", "copies", "fp", "component_id"), "texts"), "key", "copies", n, "at")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row of each group: that of the smallest id (null ids last; among
    rows of one id, any one). Columns are kept whatever their names."""
    names = docs.columns
    aside = durable(docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("uid")), "rows")
    at = {c: f"c{k}" for k, c in enumerate(names)}
    prints = durable(with_fingerprint(aside.select(F.col(at[ident]).alias("i"), F.col("uid").alias("id"), F.col(at[text]).alias("body"))), "fingerprints")
    grouped = with_facts(prints, durable(fingerprint_components(prints), "groups"), "fp", "rows", prints.count(), "id")
    keep = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("z"), "i", "id")).alias("r")).select(F.col("r.id").alias("uid"))
    return aside.join(keep.hint("shuffle_hash"), "uid", "left_semi").select(*[F.col(at[c]).alias(c) for c in names])


#: Near-copies: five-word shingles with a Jaccard similarity of 0.8 or more,
#: estimated from 256 slots; the deviation is 0.025, so the limit is one below.
WIDE_SHINGLE, SLOTS = 5, 256
SIMILARITY = 0.775
LANES = [f"s{k}" for k in range(SLOTS // 8)]
#: Candidates agree in one band of slots: 0.775 similar sketches miss all 42
#: bands once in 30,000 pairs, 0.8 similar ones once in 350,000.
BAND, BANDS = 6, SLOTS // 6
#: Fewer equal slots of a byte can be chance; then the words must agree too.
SHARED, WORD_BITS = 4, 6
#: For each slot the order in which it borrows from the others if it is empty.
TURNS = tb.mix64(np.arange(1, SLOTS * SLOTS + 1, dtype=np.uint64) * tb.RATIO).reshape(SLOTS, SLOTS).argsort(0)


#: The bits of a byte as the bytes of a word, so that one sum counts eight of them.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` owners (in order) the majority of each bit over its codes."""
    count, votes = np.bincount(owner, minlength=n), np.zeros((n, 64), np.int64)
    if len(codes):
        within = np.arange(len(codes)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(within % 255 == 0)  # what a byte can count
        lanes = codes.view(np.uint8).reshape(-1, 8)
        part = np.hstack([np.add.reduceat(SPREAD[lanes[:, k]], begin).view(np.uint8).reshape(-1, 8) for k in range(8)])
        of = owner[begin]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        votes[of[first]] = np.add.reduceat(part, first, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def sketch(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a fingerprint of its distinct words, which small edits
    hardly move, and a byte for each of ``SLOTS`` slots: of the five-word
    shingles (of all words, if there are fewer) that hash to it, the smallest."""
    starts, ends, first = tb.word_spans(data, off)
    w = tb.word_hashes(data, starts, ends, lower=True)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    _, once = np.unique(w ^ tb.mix64(doc.astype(np.uint64)), return_index=True)
    once.sort()
    words = majority(w[once], doc[once], len(n_words))
    n = np.maximum(n_words - WIDE_SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(owner))
    code = winnow.grams(w, WIDE_SHINGLE)[at]
    for k in np.flatnonzero((n == 0) & (n_words > 0)).tolist():
        code, owner = np.r_[code, winnow.grams(w[first[k] : first[k + 1]], int(n_words[k]))], np.r_[owner, k]
    least = np.full(len(n) * SLOTS, np.uint64(2**64 - 1))
    np.minimum.at(least, owner * SLOTS + (code % np.uint64(SLOTS)).astype(np.int64), code >> np.uint64(8))
    slots = np.where(least == np.uint64(2**64 - 1), EMPTY, tb.mix64(least) % np.uint64(EMPTY)).astype(np.uint8)
    return words, slots.reshape(len(n), SLOTS)


def with_sketch(rows: DataFrame, body: str, prints: bool = False) -> DataFrame:
    """``rows`` with ``sketch`` (a hash of all that follows), ``words``,
    ``LANES`` and, if ``prints`` are asked for, ``fp`` as ``with_fingerprint``
    has it."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = ["words", *LANES, *(["fp"] if prints else [])]
    schema = StructType([*rows.schema.fields, StructField("sketch", StringType()), *(StructField(c, LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, body):
            words, wide = sketch(data, off)
            lanes = wide.view(np.int64)
            more = [fingerprints(data, off).view(np.int64)] if prints else []
            whole = np.column_stack([words.view(np.int64), lanes, *more]).astype(np.int64)
            digest = [hashlib.md5(row.tobytes()).hexdigest() for row in whole]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.string()), *(pa.array(whole[:,
                k].copy()) for k in range(whole.shape[1]))], schema.names)

    return tb.map_arrow(rows, run, schema)


def band_keys(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` keys of each sketch, and whose they are. An empty slot borrows
    from the first filled one in its own order, so short texts fill all bands;
    texts without a word have no keys."""
    code = slots.astype(np.uint64) + (np.arange(SLOTS, dtype=np.uint64) << np.uint64(8))
    some = (slots != EMPTY).any(1)
    row, slot = np.nonzero((slots == EMPTY) & some[:, None])
    for turn in TURNS:
        if not len(row):
            break
        from_ = turn[slot]
        got = slots[row, from_] != EMPTY
        code[row[got], slot[got]] = slots[row[got], from_[got]] + (from_[got].astype(np.uint64) << np.uint64(8))
        row, slot = row[~got], slot[~got]
    bands = code[:, : BANDS * BAND].reshape(len(slots), BANDS, BAND)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(slots), 1))
    for k in range(BAND):
        key = tb.mix64(key * tb.RATIO + bands[:, :, k])
    return np.repeat(np.flatnonzero(some), BANDS), key[some].ravel()


def band_links(nodes: DataFrame, similarity: float, group_rows: int | None = None) -> DataFrame:
    """``node, words, *LANES`` -> edges ``(a, b)`` that connect all nodes which
    share a band and whose sketches agree in ``similarity`` of the slots.

    Nodes are listed by band; lists of one go, and the rest carry their
    sketches into groups that return spanning forests, never all pairs. A list
    of more than ``group_rows`` is cut into chunks, each with a few pivots of
    the whole list, so that a list of near-copies hangs together after one
    step. What does not hang together with most of a list then meets all of
    it, chunk by chunk; only pairs not yet connected are compared.
    """
    group_rows = group_rows or GROUP_ROWS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.stack([batch.column(k + 1).to_numpy() for k in range(len(LANES))], axis=1)
            row, key = band_keys(lanes.view(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(key.view(np.int64))], ["node", "key"])

    listed = durable(tb.map_arrow(nodes.select("node", *LANES), keys, "node long, key long"), "bands")
    counts = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = with_facts(listed, counts, "key", "n", listed.count(), "node").where("n is not null")
    met = durable(met, "bands")
    parts = F.ceil(F.col("n") / group_rows)
    hot = met.where(F.col("n") > group_rows)
    if hot.isEmpty():
        return _compared(met.select("key", F.lit(0).alias("x"), "node", F.col("node").alias("label")), nodes, similarity)
    ranked = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node"))["node"] for j in range(PIVOTS)]
    pivots = hot.groupBy("key", "n").agg(F.array_distinct(F.array(*ranked)).alias("p"))
    pivots = pivots.select("key", parts.alias("c"), F.explode("p").alias("node")).select("key", F.explode(F.sequence(F.lit(0).cast("long"),
        F.col("c") - 1)).alias("x"), "node")
    chunked = met.select("key", F.pmod(F.xxhash64("node"), parts).alias("x"), "node").unionByName(pivots).withColumn("label", F.col("node"))
    first = durable(_compared(chunked, nodes, similarity), "links")
    names = connected_components(first).withColumnRenamed("component", "label")
    named = durable(hot.select("key", "node").join(names, "node", "left").withColumn("label", F.coalesce("label", "node")), "hot")
    size = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    lists = size.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1")
    lists = lists.select("key", "all", F.ceil(F.col("most.n") / group_rows).alias("majors"),
        F.ceil((F.col("all") - F.col("most.n")) / group_rows).alias("minors"), F.col("most.label").alias("top"))
    rows = with_facts(named, lists, "key", "all", named.count(), "node").where("all is not null")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    # a stray's chunk meets the chunks of most (numbered from zero) and those of strays (below)
    most = F.transform(upto(F.col("minors")), lambda m: m * F.col("majors") + at("majors"))
    stray = F.concat(
        F.transform(upto(F.col("majors")), lambda j: at("minors") * F.col("majors") + j),
        F.transform(upto(F.col("minors")), lambda m: -1 - (F.least(m, at("minors")) * F.col("minors") + F.greatest(m, at("minors")))),
    )
    again = rows.select("key", F.explode(F.when(F.col("label") == F.col("top"), most).otherwise(stray)).alias("x"), "node", "label")
    return first.unionByName(_compared(again, nodes, similarity))


def _compared(groups: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Spanning links of each group ``(key, x)`` of nodes, of which those of
    one ``label`` are connected already."""
    dealt = groups.join(nodes.hint("shuffle_hash"), "node").select("node", "key", "x", "label", "words", *LANES)
    dealt = dealt.repartition("key", "x").sortWithinPartitions("key", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tb.whole_groups(batches, ["key", "x"]):
            column = [table.column(c).to_numpy() for c in ("node", "key", "x", "label", "words")]
            lanes = np.stack([table.column(c).to_numpy() for c in LANES], axis=1).view(np.uint8)
            a, b = band_linked(*column[:4], column[4].view(np.uint64), lanes, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tb.map_arrow(dealt, run, "a long, b long")


def band_linked(node: np.ndarray, key: np.ndarray, x: np.ndarray, known: np.ndarray, words: np.ndarray, lanes: np.ndarray,
    similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each group of equal (key, x), sorted by it. Pairs
    that are connected already are not compared."""
    group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (x[1:] != x[:-1])]) if len(node) else node
    order = np.lexsort((known, group))
    same = (group[order][1:] == group[order][:-1]) & (known[order][1:] == known[order][:-1])
    start = tb.spanning(order[1:][same], order[:-1][same], len(node))
    label, moved = start, np.flatnonzero(start != np.arange(len(node)))
    for i, j in tb.group_pairs(group):
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        ok = similar(lanes, words, i, j, similarity)
        if ok.any():
            label = tb.spanning(np.r_[moved, i[ok]], np.r_[label[moved], j[ok]], len(node))
            moved = np.flatnonzero(label != np.arange(len(node)))
    new = moved[label[moved] != start[moved]]
    return node[new], node[label[new]]


def similar(lanes: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs have sketches that agree in ``similarity`` of the slots that
    either fills, and not by chance."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        p, q = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        x, y = lanes[p], lanes[q]
        filled = (x != EMPTY) | (y != EMPTY)
        equal = ((x == y) & filled).sum(1)
        sure = (equal >= SHARED) | (np.bitwise_count(words[p] ^ words[q]) <= WORD_BITS)
        out[at : at + (1 << 15)] = sure & (equal >= similarity * filled.sum(1))
    return out


def print_links(nodes: DataFrame, ring: Ring) -> DataFrame:
    """``node, fp`` -> edges ``(a, b)`` that connect all nodes whose fingerprints
    are equal or, by ``ring_links``, near each other."""
    nodes = nodes.select("node", "fp")
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("copies")), "fingerprints")
    equal = with_facts(nodes, prints.where("copies > 1"), "fp", "copies", nodes.count(), "node").where("least <> node")
    return ring_links(prints.select("fp", F.col("least").alias("node")), ring=ring).unionByName(equal.select(F.col("least").alias("a"), F.col("node").alias("b")))


def near_copy_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", ring: Ring | None = None) -> DataFrame:
    """One row of each group of near-copies, that of the smallest id (null ids
    last; among rows of one id, any one).

    Rows link if the sketches of their five-word shingles agree in
    ``SIMILARITY`` of the slots; pairs that share a band of slots are compared.
    If fewer than ``SHARED`` slots agree, the fingerprints of their distinct
    words must be within ``WORD_BITS`` bits too. Given a ``ring``, rows whose
    SimHash fingerprints (see ``simhash_groups``) it finds near each other link
    as well, and a group hangs together by links of either kind. Rows of equal
    sketch and fingerprints, such as repeated ones, are one node. Texts without a word
    (null, empty, blank) are copies of each other; very long texts are read
    whole. Columns are kept whatever their names. An empty table gives an empty
    result.
    """
    names = docs.columns
    at = {c: f"c{k}" for k, c in enumerate(names)}
    aside = docs.select(*[docs[c].alias(at[c]) for c in names], F.monotonically_increasing_id().alias("uid"))
    rows = durable(with_sketch(aside, at[text], ring is not None), "sketches")
    told = ["words", *LANES, *(["fp"] if ring else [])]
    slim = rows.select(F.col(at[ident]).alias("id"), "uid", "sketch", *told)
    nodes = slim.groupBy("sketch").agg(F.min("uid").alias("node"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in told])
    nodes = durable(nodes, "nodes")
    links = band_links(nodes.select("node", "words", *LANES), SIMILARITY)
    parts = connected_components(links.unionByName(print_links(nodes, ring)) if ring else links)
    labelled = nodes.select("sketch", "copies", "node").join(parts, "node", "left").select("sketch", "copies", F.coalesce("component", "node").alias("g"))
    mine = with_facts(slim.select("id", "uid", "sketch"), durable(labelled, "groups"), "sketch", "copies", slim.count(), "uid")
    keep = mine.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "uid")).alias("r")).select(F.col("r.uid").alias("uid"))
    return rows.join(keep.hint("shuffle_hash"), "uid", "left_semi").select(*[F.col(at[c]).alias(c) for c in names])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")

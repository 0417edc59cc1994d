"""Interpolated modified Kneser-Ney scoring, of order two or three.

Counts are made in Spark, kept as sorted hash arrays in the shared folder and
memory-mapped by the scoring workers. Order two is what the disk budget of the
check tool allows in production; see the README.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import sharedfiles
from lettermill.llm import textbytes as tb
from lettermill.llm.langid import fold
from lettermill.llm.mixing import WORD
from lettermill.session import durable, new_path, shuffle_partitions

BEGIN, END = np.uint64(0xB0B0B0B0B0B0B0B1), np.uint64(0xE0E0E0E0E0E0E0E1)
ORDER = 2
FLUSH_TOKENS = 2_000_000
SHARD_BYTES = 24 << 20
SAMPLE_DOCS = 2000
HOT_SHARE = 0.0005
MAX_BITS = 24  # of a context in a key
U64, U32 = np.uint64, np.uint32


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token (each text's words, A-Z lower-cased,
    then one end), and each text's n+1 positions."""
    starts, ends, first = tb.word_spans(data, off)
    hashes = tb.word_hashes(data, starts, ends, lower=True)
    edge = first + np.arange(len(first))
    w = np.empty(len(hashes) + len(off) - 1, U64)
    w[edge[1:] - 1] = END
    mine = np.ones(len(w), bool)
    mine[edge[1:] - 1] = False
    w[mine] = hashes
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[edge[:-1]] = BEGIN
    return v, w, edge


def bigram_keys(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """64-bit keys. 24 bits of the context lead, so that its bigrams share a
    shard; those of a hot context are spread by all bits."""
    both = tb.mix64(v * tb.RATIO + w)
    lead = tb.mix64(v)
    key = (lead >> U64(40) << U64(40)) | (both >> U64(24))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        key = np.where(hot[at] == v, both, key)
    return key


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position of each distinct key's first row in sorted order, and sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order[begin], *(np.add.reduceat(c[order], begin) if len(begin) else c[:0] for c in counts)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    lens, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(lens.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def bounds_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits shards begins and ends in sorted keys."""
    inner = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
    return np.r_[0, np.searchsorted(keys, inner), len(keys)]


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    word_bits: int  # words need fewer shards than bigrams
    hot: np.ndarray
    docs: int  # training texts: the count of the end token
    tokens: int  # N
    order: int
    words: int  # V
    types: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float  # mass that single words leave to the uniform distribution
    top_discounts: tuple[float, float, float]  # of order three


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    wanted = [k - (k + 1) * y * (b / a) if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for d, k in zip(wanted, (1, 2, 3), strict=True))


def less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)], 0.0)


def hot_contexts(train: DataFrame, text: str, n: int) -> np.ndarray:
    """Words frequent in a bounded sample, and the text's beginning. They only
    decide how counts are spread over tasks, never a count."""
    drawn = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in tb.chunks(batches, text):
            w, c = np.unique(tokens(data, off)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[w, U64(0)].view(np.int64)), pa.array(np.r_[c, c.sum()])], ["w", "c"])

    sample = train.where(drawn < min(1.0, SAMPLE_DOCS / max(n, 1))).select(text)
    sums = tb.map_arrow(sample, run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    # the sample's size stands first; at most 1 / HOT_SHARE words can have that share of it
    rows = sums.orderBy(F.col("c").desc(), "w").limit(int(1 / HOT_SHARE) + 1).collect()
    whole = max((r["c"] for r in rows if r["w"] == 0), default=0)
    rows = [r for r in rows if r["c"] >= whole * HOT_SHARE]
    return np.unique(np.r_[np.array([r["w"] for r in rows if r["w"]], np.int64).view(U64), BEGIN])


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tb.mix64(u * tb.RATIO + v)


def before(v: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The token before each context (the beginning, twice)."""
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[edge[:-1]] = BEGIN
    return u


def count_trigrams(train: DataFrame, text: str, bits: int) -> DataFrame:
    """As ``count_bigrams``, with contexts of two words, whose second one stands beside their hash."""

    def flush(us: list[np.ndarray], vs: list[np.ndarray], ws: list[np.ndarray]) -> pa.RecordBatch:
        u, v, w = map(np.concatenate, (us, vs, ws))
        c = pair_hash(u, v)
        key = bigram_keys(c, w, HOT_PAIR)
        at, n = summed(key, np.ones(len(key), np.int64))
        edge = bounds_of(key[at], bits)
        c, v, w = c[at], v[at], w[at]
        shards, blobs = [], []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[s], edge[s + 1]
            begin = np.flatnonzero(np.r_[True, c[a + 1 : b] != c[a : b - 1]])
            shards.append(s)
            blobs.append(pack(c[a:b][begin], v[a:b][begin], np.diff(np.r_[begin, b - a]).astype(U32), w[a:b], n[a:b].astype(U32)))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = ([], [], []), 0
        for _, data, off in tb.chunks(batches, text):
            v, w, edge = tokens(data, off)
            for have_, x in zip(held, (before(v, edge), v, w), strict=True):
                have_.append(x)
            have += len(v)
            if have >= FLUSH_TOKENS:
                yield flush(*held)
                held, have = ([], [], []), 0
        if have:
            yield flush(*held)

    return tb.map_arrow(train.select(text), run, "shard int, blob binary")


#: The first two tokens of a text have the one context that all texts share.
HOT_PAIR = pair_hash(np.array([BEGIN]), np.array([BEGIN]))


def merge_trigrams(counted: DataFrame, folder: str, bits: int, word_bits: int, hot: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Write each shard's trigram counts, then the contexts of two words and
    the counts of single words; return bigrams, counted by the words before
    them, as ``count_bigrams`` does, and the counts of counts."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [unpack(b.as_buffer(), [U64, U64, U32, U64, U32]) for b in table.column("blob")]
        c, v = (np.concatenate([np.repeat(p[k], p[2]) for p in parts]) for k in (0, 1))
        w = np.concatenate([p[3] for p in parts])
        key = bigram_keys(c, w, HOT_PAIR)
        at, n = summed(key, np.concatenate([p[4] for p in parts]).astype(np.int64))
        sharedfiles.write_arrays(folder, f"t{shard}", [key[at], n.astype(U32)])
        c, v, w = c[at], v[at], w[at]
        out: list[tuple[str, int, bytes]] = []

        def deal(kind: str, key: np.ndarray, bits: int, *columns: np.ndarray) -> None:
            order = np.argsort(key, kind="stable")
            edge = bounds_of(key[order], bits)
            for s in np.flatnonzero(np.diff(edge)).tolist():
                out.append((kind, s, pack(*(x[order][edge[s] : edge[s + 1]] for x in columns))))

        cs, *per = summed(c, n, *((n == k).astype(np.int64) for k in (1, 2)), (n >= 3).astype(np.int64))
        deal("c", c[cs], bits, c[cs], *(x.astype(U32) for x in per))
        vs, raw = summed(v, n)
        deal("r", v[vs], word_bits, v[vs], raw)
        pair = bigram_keys(v, w, hot)
        ps, types = summed(pair, np.ones(len(pair), np.int64))
        deal("b", pair[ps], bits, v[ps], np.ones(len(ps), U32), w[ps], types.astype(U32))
        of_counts = [[int((n == k).sum()) for k in (1, 2, 3, 4)]] + [None] * (len(out) - 1)
        kinds, shards, blobs = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kinds), "shard": pa.array(shards, pa.int32()), "blob": pa.array(blobs, pa.binary()),
            "n": pa.array(of_counts, pa.list_(pa.int64()))})

    def write(kind: str, columns: list[type]) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            got = [unpack(b.as_buffer(), columns) for b in table.column("blob")]
            key = np.concatenate([g[0] for g in got])
            at, *sums = summed(key, *(np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(1, len(columns))))
            sharedfiles.write_arrays(folder, f"{kind}{shard}", [key[at], *(x.astype(c) for x, c in zip(sums, columns[1:], strict=True))])
            return pa.table({"n": [len(at)]})

        return run

    merged = durable(counted.repartitionById(1 << bits, "shard").groupBy("shard").applyInArrow(merge,
        "kind string, shard int, blob binary, n array<long>"), "trigrams")
    for kind, wide, columns in (("c", bits, [U64, U32, U32, U32, U32]), ("r", word_bits, [U64, np.int64])):
        part = merged.where(F.col("kind") == kind).select("shard", "blob")
        part.repartitionById(1 << wide, "shard").groupBy("shard").applyInArrow(write(kind, columns), "n long").agg(F.sum("n")).collect()
    sums = merged.where("n is not null").select(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4)]).first()
    return merged.where("kind = 'b'").select("shard", "blob"), np.array([x or 0 for x in sums])


def count_bigrams(train: DataFrame, text: str, bits: int, hot: np.ndarray) -> DataFrame:
    """``(shard, blob)``: bigrams of the texts with counts, summed over a few million tokens."""

    def flush(vs: list[np.ndarray], ws: list[np.ndarray]) -> pa.RecordBatch:
        v, w = np.concatenate(vs), np.concatenate(ws)
        key = bigram_keys(v, w, hot)
        at, n = summed(key, np.ones(len(key), np.int64))
        edge = bounds_of(key[at], bits)
        v, w = v[at], w[at]
        shards, blobs = [], []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[s], edge[s + 1]
            begin = np.flatnonzero(np.r_[True, v[a + 1 : b] != v[a : b - 1]])
            shards.append(s)
            blobs.append(pack(v[a:b][begin], np.diff(np.r_[begin, b - a]).astype(U32), w[a:b], n[a:b].astype(U32)))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vs, ws, have = [], [], 0
        for _, data, off in tb.chunks(batches, text):
            v, w, _ = tokens(data, off)
            vs.append(v)
            ws.append(w)
            have += len(v)
            if have >= FLUSH_TOKENS:
                yield flush(vs, ws)
                vs, ws, have = [], [], 0
        if have:
            yield flush(vs, ws)

    return tb.map_arrow(train.select(text), run, "shard int, blob binary")


def merge_bigrams(counted: DataFrame, folder: str, bits: int, word_bits: int, hot: np.ndarray) -> DataFrame:
    """Write each shard's bigram counts, a task for each; ``(shard, blob, n)`` has for each shard
    of words what contexts and words need, and (once a shard) counts of counts."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [unpack(b.as_buffer(), [U64, U32, U64, U32]) for b in table.column("blob")]
        v = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        w = np.concatenate([p[2] for p in parts])
        key = bigram_keys(v, w, hot)
        at, n = summed(key, np.concatenate([p[3] for p in parts]).astype(np.int64))
        sharedfiles.write_arrays(folder, f"b{shard}", [key[at], n.astype(U32)])
        v, w = v[at], w[at]
        vs, *per = summed(v, n, *((n == k).astype(np.int64) for k in (1, 2)), (n >= 3).astype(np.int64))
        ws, types = summed(w, np.ones(len(w), np.int64))
        v, w = v[vs], w[ws]
        ve, we = bounds_of(v, word_bits), bounds_of(w, word_bits)
        shards, blobs = [], []
        for s in np.flatnonzero(np.diff(ve) + np.diff(we)).tolist():
            i, j = slice(ve[s], ve[s + 1]), slice(we[s], we[s + 1])
            shards.append(s)
            blobs.append(pack(v[i], *(x[i].astype(U32) for x in per), w[j], types[j].astype(U32)))
        of_counts = [[int((n == k).sum()) for k in (1, 2, 3, 4)]] + [None] * (len(shards) - 1)
        return pa.table({"shard": pa.array(shards, pa.int32()), "blob": pa.array(blobs, pa.binary()), "n": pa.array(of_counts, pa.list_(pa.int64()))})

    return counted.repartitionById(1 << bits, "shard").groupBy("shard").applyInArrow(merge, "shard int, blob binary, n array<long>")


def merge_words(parts: DataFrame, folder: str, word_bits: int) -> DataFrame:
    """Write each shard of words: hash, count, followers seen once, twice and
    more often, and predecessors; return each shard's sums."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        got = [unpack(b.as_buffer(), [U64, U32, U32, U32, U32, U64, U32]) for b in table.column("blob")]
        nv, nw = sum(len(p[0]) for p in got), sum(len(p[5]) for p in got)
        key = np.concatenate([p[0] for p in got] + [p[5] for p in got])
        cols = [np.r_[np.concatenate([p[k] for p in got]).astype(np.int64), np.zeros(nw, np.int64)] for k in (1, 2, 3, 4)]
        cols.append(np.r_[np.zeros(nv, np.int64), np.concatenate([p[6] for p in got]).astype(np.int64)])
        at, total, one, two, more, types = summed(key, *cols)
        key = key[at]
        sharedfiles.write_arrays(folder, f"w{shard}", [key, total.astype(U64), one.astype(U32), two.astype(U32), more.astype(U32), types.astype(U32)])
        real = key != BEGIN
        of_counts = [r for r in table.column("n").to_pylist() if r]
        return pa.table({
            "docs": [int(total[~real].sum())], "tokens": [int(total[real].sum())], "words": [int((total[real] > 0).sum())], "types": [int(types.sum())],
            "n": pa.array([np.sum(of_counts, axis=0).tolist() if of_counts else [0] * 4], pa.list_(pa.int64())),
            "m": pa.array([[int((types == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())),
            "more": [int((types >= 3).sum())],
        })

    return parts.repartitionById(1 << word_bits, "shard").groupBy("shard").applyInArrow(merge,
        "docs long, tokens long, words long, types long, n array<long>, m array<long>, more long")


def train_model(train: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count all of ``train`` and write the model of ``order`` two or three to
    the shared folder. Lower orders are counted by the distinct words before.

    The number of shards follows the bytes of text, so that one shard, all a
    task holds at a time, stays of one size, up to 400 TB.
    """
    spark = train.sparkSession
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    wanted = max(4, shuffle_partitions(spark), -(-size["b"] // SHARD_BYTES))
    bits = min(MAX_BITS, int(wanted - 1).bit_length())
    word_bits = max(1, bits - 2)
    hot = hot_contexts(train, text, size["n"])
    folder = new_path(spark, "kneserney")
    if order == 3:
        counted, top = merge_trigrams(count_trigrams(train, text, bits), folder, bits, word_bits, hot)
    elif order == 2:
        counted, top = count_bigrams(train, text, bits, hot), np.zeros(4)
    else:
        raise ValueError(f"the order is two or three, not {order}")
    sums = merge_words(merge_bigrams(counted, folder, bits, word_bits, hot), folder, word_bits).collect()  # a row a shard
    total = {k: sum(r[k] for r in sums) for k in ("docs", "tokens", "words", "types", "more")}
    n, m = (np.sum([r[k] for r in sums], axis=0) if sums else np.zeros(4) for k in ("n", "m"))
    d = discounts(m)
    rest = (d[0] * m[0] + d[1] * m[1] + d[2] * total["more"]) / total["types"] if total["types"] else 1.0
    n_tokens, n_docs = total["tokens"] + total["docs"], total["docs"]
    if order == 3:  # contexts are counted by distinct words before, single words and texts are not
        n_docs = size["n"]
        n_tokens = train.select(F.sum(F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))).alias("n")).first()["n"] or 0
        n_tokens += n_docs
    return Model(folder, bits, word_bits, hot, n_docs, n_tokens, order, total["words"] + (total["docs"] > 0), total["types"], discounts(n), d,
        float(rest), discounts(top))


class Reader:
    """A worker's view of the model; shards are mapped when first needed."""

    KINDS = {"b": [U64, U32], "w": [U64, U64, U32, U32, U32, U32], "t": [U64, U32], "c": [U64, U32, U32, U32, U32], "r": [U64, np.int64]}

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def look_up(self, kind: str, keys: np.ndarray) -> list[np.ndarray]:
        """Values of sorted keys, zero where a key is unknown."""
        out = [np.zeros(len(keys), np.int64) for _ in self.KINDS[kind][1:]]
        edge = bounds_of(keys, self.model.word_bits if kind in "wr" else self.model.bits)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if (kind, s) not in self.open:
                self.open[kind, s] = sharedfiles.map_arrays(self.model.folder, f"{kind}{s}", self.KINDS[kind])
            if not (have := self.open[kind, s]) or not len(have[0]):
                continue
            part = slice(edge[s], edge[s + 1])
            at = np.minimum(np.searchsorted(have[0], keys[part]), len(have[0]) - 1)
            hit = have[0][at] == keys[part]
            for o, column in zip(out, have[1:], strict=True):
                o[part] = np.where(hit, column[at], 0)
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, unigram base and model log10 probability."""
        m = self.model
        v, w, edge = tokens(data, off)
        words, place = np.unique(np.r_[v, w], return_inverse=True)
        total, one, two, more, types = self.look_up("w", words)
        seen = total.copy() if m.order == 2 else self.look_up("r", words)[0]
        seen[words == END] = m.docs
        single = m.word_rest / (m.words + 1) + less(types, m.word_discounts) / max(m.types, 1)
        rest = m.discounts[0] * one + m.discounts[1] * two + m.discounts[2] * more
        keys, at = np.unique(bigram_keys(v, w, m.hot), return_inverse=True)
        (count,) = self.look_up("b", keys)
        i, j = place[: len(v)], place[len(v) :]
        context = total[i]
        high = (less(count, m.discounts)[at] + rest[i] * single[j]) / np.maximum(context, 1)
        high = np.where(context > 0, high, single[j])
        if m.order == 3:
            pairs, of = np.unique(c := pair_hash(before(v, edge), v), return_inverse=True)
            total, one, two, more = self.look_up("c", pairs)
            rest = m.top_discounts[0] * one + m.top_discounts[1] * two + m.top_discounts[2] * more
            keys, at = np.unique(bigram_keys(c, w, HOT_PAIR), return_inverse=True)
            (count,) = self.look_up("t", keys)
            top = (less(count, m.top_discounts)[at] + rest[of] * high) / np.maximum(total[of], 1)
            high = np.where(total[of] > 0, top, high)
        logs = np.log10(high)
        known = seen[j]
        base = np.log10((known + 1) / (m.tokens + (m.words + 1)))
        add = lambda x: np.add.reduceat(x, edge[:-1])  # noqa: E731  every text has a token
        return np.diff(edge), add((known > 0).astype(np.int64)), add(base), add(logs)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` (log10 probability) and ``perplexity``; columns of those names are
    replaced.

    Tokens are the words of the text with A-Z lower-cased, then one end, so a
    null or empty text is one token. Unknown words share the probability that
    the discounts leave to one more word. With nothing to learn from, all
    words are unknown. Repeated rows are learned from as often as they occur
    and score alike, so ties need no order; very long texts are scored whole.
    Other columns are kept whatever their names. An empty table gives an empty
    result.
    """
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    names = {"n_tokens": LongType(), "n_known": LongType(), "train_tokens": LongType(), "base_score": DoubleType(), "score": DoubleType(),
        "perplexity": DoubleType()}
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *(StructField(k, t) for k, t in names.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part, data, off in tb.chunks(batches, text):
            n, known, base, logs = reader.score(data, off)
            new = [n, known, np.full(len(n), model.tokens), base, logs, 10.0 ** np.minimum(-logs / n, 300.0)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(new, [pa.int64()] * 3 + [pa.float64()] * 3,
                strict=True))], schema.names)

    return tb.map_arrow(docs, run, schema)


def op10_kneserney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model = train_model(docs.where(~held))
    rows = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

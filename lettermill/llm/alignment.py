"""Alignment of two tokenizers' tokens over the bytes of each text."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lettermill.llm import textbytes as tb
from lettermill.session import durable

FOLDER = os.environ.get("LETTERMILL_TOKENIZERS", "/opt/tokenizers")
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments whose tokens a worker keeps before it begins anew (100 to 200 MB).
KEPT_SEGMENTS = 1 << 19
BLOCK_BYTES = 1 << 12
HELD_PAIRS = 1 << 21
#: Pairs with more than this part of all links are broadcast: fewer than so many.
FREQUENT = 1 << 19
#: The second library splits words as the first does below this code point, and is quick with short ones.
PLAIN, SHORT = 0x250, 256
B_BITS = 16
#: First bytes of characters behind a blank that may be white space themselves: no cut there.
NO_CUT = np.arange(256) <= 0x20
NO_CUT[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@dataclass(frozen=True)
class Vocabularies:
    """The two tokenizers' files: a byte-level BPE (JSON of ``tokenizers``) and
    a BPE of pieces (model of ``sentencepiece``). The driver reads them and
    sends them with the tasks (some MB), so workers need no such files."""

    a: str
    b: bytes

    @staticmethod
    def read(folder: str = FOLDER) -> Vocabularies:
        with open(f"{folder}/{BYTES_FILE}", encoding="utf-8") as f, open(f"{folder}/{PIECES_FILE}", "rb") as g:
            return Vocabularies(f.read(), g.read())


@lru_cache(maxsize=1)
def aligner(files: Vocabularies, written: bool) -> Aligner:
    """The worker's aligner, which outlives its tasks."""
    return Aligner(files, written)


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the
    others as the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Tokens of segments and how they overlap, with what was found kept: by
    the place of a segment its ``facts`` (tokens of A and of B, groups, links),
    whether it is ``ok`` (B's bytes are the segment's), its groups ``written``
    out (if asked for), and its links, ``a << 16 | b``, between two ``edge``.

    A segment ends before a blank that follows none and comes before a
    character that is no white space. No token of either vocabulary crosses
    such a place (A splits words there before it merges; no piece of B has a
    blank behind another character, which is checked), so a text's tokens are
    those of its segments.
    """

    def __init__(self, files: Vocabularies, written: bool = True) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(files.a)
        self.whole.encode_special_tokens = True
        told = json.loads(files.a)
        known = told["model"]["vocab"]
        split = told["pre_tokenizer"]
        if told["normalizer"] or (split["type"], split["use_regex"], split["add_prefix_space"]) != ("ByteLevel", True, False):
            raise ValueError("A is not a plain byte-level vocabulary that splits words")
        letter = byte_of_letter()
        special = {t["content"] for t in told["added_tokens"]}
        raw = {i: bytes(letter[c] for c in t) for t, i in known.items() if t not in special}
        self.a_len = np.zeros(max(known.values()) + 1, np.int64)
        for i, t in raw.items():
            self.a_len[i] = len(t)
        merges = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        ranked = all(known[m.replace(" ", "")] == 256 + k for k, m in enumerate(merges))
        # the published pattern of byte-level vocabularies: contractions, words, numbers, signs, white space
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in raw.items()}, special_tokens={}) if ranked else None

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece of B has a blank inside")
        if len(names) > 1 << B_BITS or len(self.a_len) > 1 << B_BITS:
            raise ValueError("ids have more than 16 bits")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        n = max(len(self.a_len), len(names))
        self.shown = pa.array([f"{i}{end}".encode() for end in ",|;" for i in range(n)], pa.large_binary())
        self.n_shown = n
        self.write = written
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.facts, self.ok, self.written = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.links, self.edge = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, segments: list[bytes]) -> np.ndarray:
        """The places of segments, each of which begins with a blank; good until the next call."""
        if len(self.place) > KEPT_SEGMENTS:
            self.clear()
        at = np.fromiter(map(self.place.get, segments, repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.place) + np.arange(len(missing))
            new = [segments[k] for k in missing.tolist()]
            self.place.update(zip(new, at[missing].tolist(), strict=True))
            facts, ok, written, links, edge = self.aligned(new)
            self.facts, self.ok = np.concatenate([self.facts, facts]), np.r_[self.ok, ok]
            self.links, self.edge = np.r_[self.links, links], np.r_[self.edge, self.edge[-1] + edge[1:]]
            self.written += written
        return at

    def links_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some places, and their bounds."""
        n = self.edge[at + 1] - self.edge[at]
        edge = np.r_[0, np.cumsum(n)]
        return self.links[np.arange(edge[-1]) + np.repeat(self.edge[at] - edge[:-1], n)], edge

    def tokens_of_a(self, segments: list[bytes], clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids, and how many each segment has. Those that are ``clean`` are
        one text for the quick library, as no token crosses their bounds."""
        ids, counts = [], np.zeros(len(segments), np.int64)
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        quick = np.flatnonzero(clean & (lens <= SHORT)) if self.quick else np.zeros(0, np.int64)
        text = b"".join([segments[k] for k in quick.tolist()]).decode()
        if text and max(text) >= chr(PLAIN):
            quick = np.array([k for k in quick.tolist() if max(segments[k].decode()) < chr(PLAIN)], np.int64)
            text = b"".join([segments[k] for k in quick.tolist()]).decode()
        if text:
            got = self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            ends, upto = np.cumsum(self.a_len[got]), np.cumsum(lens[quick])
            edge = np.searchsorted(ends, upto, "right")
            assert (ends[edge - 1] == upto).all(), "a token of A crosses segments"
            counts[quick] = np.diff(np.r_[0, edge])
            ids.append(got)
        rest = np.setdiff1d(np.arange(len(segments)), quick)
        for k, got in zip(rest.tolist(), self.whole.encode_batch([segments[k].decode() for k in rest.tolist()], add_special_tokens=False), strict=True):
            counts[k] = len(got.ids)
            ids.append(np.array(got.ids, np.int64))
        order = np.concatenate([quick, rest])
        return in_order(np.concatenate(ids), counts[order], order), counts

    def tokens_of_b(self, segments: list[bytes], clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """B's ids (none where its bytes are not the segment's), how many each
        segment has, and whether it is so. Clean segments are encoded some
        kilobytes at a time, as no token crosses their bounds."""
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        joined, rest = np.flatnonzero(clean), np.flatnonzero(~clean)
        cuts = np.searchsorted(np.cumsum(lens[joined]), np.arange(0, int(lens[joined].sum()), BLOCK_BYTES)[1:]).tolist()
        parts = [p for p in np.split(joined, cuts) if len(p)] + [rest[k : k + 1] for k in range(len(rest))]
        raw = [b"".join([segments[k] for k in p.tolist()]) for p in parts]
        told = self.pieces.encode([r[1:].decode() for r in raw], num_threads=1)
        ids, counts, ok = [], np.zeros(len(segments), np.int64), np.ones(len(segments), bool)
        order = []
        for p, r, got in zip(parts, raw, told, strict=True):
            if b"".join([self.b_bytes[i] for i in got]) == r:
                got = np.array(got, np.int64)
                edge = np.searchsorted(np.cumsum(self.b_len[got]), np.cumsum(lens[p]), "right")
                counts[p] = np.diff(np.r_[0, edge])
            elif len(p) == 1:
                got, ok[p] = np.zeros(0, np.int64), False
            else:  # one of them has a blank that is none
                each = self.pieces.encode([segments[k][1:].decode() for k in p.tolist()], num_threads=1)
                same = [b"".join([self.b_bytes[i] for i in x]) == segments[k] for k, x in zip(p.tolist(), each, strict=True)]
                each = [x if s else [] for x, s in zip(each, same, strict=True)]
                ok[p], counts[p] = same, list(map(len, each))
                got = np.array([i for x in each for i in x], np.int64)
            ids.append(got)
            order.append(p)
        order = np.concatenate(order)
        return in_order(np.concatenate(ids), counts[order], order), counts, ok

    def aligned(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Facts, ok, groups, links and their bounds."""
        clean = np.array([len(s) > 1 and not NO_CUT[s[1]] and s[-1] != 32 for s in segments], bool)
        b, n_b, ok = self.tokens_of_b(segments, clean)
        a, n_a = self.tokens_of_a(segments, clean)
        if not ok.all():
            a, n_a = a[np.repeat(ok, n_a)], np.where(ok, n_a, 0)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_begin, b_begin = a_end - self.a_len[a], b_end - self.b_len[b]
        # B's tokens are the index: those that a token of A overlaps stand between two bisections
        low, high = np.searchsorted(b_end, a_begin, "right"), np.searchsorted(b_begin, a_end, "left")
        # a gap between tokens of B that no token of A spans ends a group
        spanned = np.bincount(low + 1, minlength=len(b) + 1) - np.bincount(high, minlength=len(b) + 1)
        open_ = np.cumsum(spanned)[1:] > 0
        group_b = np.cumsum(np.r_[0, ~open_[:-1]])[: len(b)]
        group_a = group_b[low]
        n_links = high - low
        pair_a, first = np.repeat(np.arange(len(a)), n_links), np.cumsum(n_links) - n_links
        links = (a[pair_a] << B_BITS | b[np.arange(len(pair_a)) - first[pair_a] + low[pair_a]]).astype(np.uint32)
        a_edge, b_edge = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        edge = np.r_[first, len(links)][a_edge]
        bounds = np.r_[group_b, group_b[-1] + 1 if len(b) else 0]  # segments share no group
        facts = np.stack([n_a, n_b, np.diff(bounds[b_edge]), np.diff(edge)], 1)
        written = self.written_out(a, b, group_a, group_b, a_edge + b_edge) if self.write else []
        return facts, ok, written, links, edge

    def written_out(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """Each segment's groups: first their tokens of A, then of B, and a sign behind every token."""
        if not len(a):
            return [b""] * (len(edge) - 1)
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        sign = np.r_[np.where(last_a, 1, 0), np.where(last_b, 2, 0)]
        told = self.shown.take(pa.array((np.r_[a, b] + sign * self.n_shown)[order]))
        at, raw = np.frombuffer(told.buffers()[1], np.int64)[edge].tolist(), told.buffers()[2].to_pybytes()
        return [raw[x : y - 1] if y > x else b"" for x, y in zip(at, at[1:], strict=False)]


def in_order(ids: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``ids``, of ``counts``, that stand in ``order``, by their numbers."""
    begin, back = np.cumsum(counts) - counts, np.argsort(order)
    n = counts[back]
    return ids[np.arange(len(ids)) + np.repeat(begin[back] - (np.cumsum(n) - n), n)]


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a blank before each: bytes, the starts of all segments
    (and the end), and the texts' bounds in them. Empty texts have none."""
    full = off[1:] > off[:-1]
    shift = np.cumsum(full)
    out = np.full(len(data) + int(shift[-1]) if len(shift) else 0, 32, np.uint8)
    lens = np.diff(off)
    out[np.arange(len(data)) + np.repeat(shift, lens)] = data
    edge = off + np.r_[0, shift]
    blank = out == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[:-1] &= ~NO_CUT[out[1:]]
    start[-1:] = False
    begins = edge[:-1][full]
    start[begins] = True
    starts = np.flatnonzero(start)
    return out, np.r_[starts, len(out)], np.searchsorted(starts, edge)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct segments and the place of each in them."""
    if len(starts) < 2:
        return [], np.zeros(0, np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
    found = array.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the segments' values for each text."""
    return np.diff(np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0)])[first], axis=0)


def segments_of(data: np.ndarray, off: np.ndarray, align: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of some texts' distinct segments, the number of each segment
    among them, the texts' bounds in the segments, and whether a text has tokens at all."""
    out, starts, first = cut(data, off)
    known, code = distinct(out, starts)
    at = align(known)
    bad = by_text((~align.ok[at])[code].astype(np.int64), first)
    return at, code, first, (np.diff(first) > 0) & (bad == 0)


def pair_counts(docs: DataFrame, files: Vocabularies, text: str = "text") -> DataFrame:
    """``(pair, n)``: how many links of the whole corpus hold each pair of ids
    (``a << 16 | b``), summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, pairs, counts = aligner(shared.value, False), [], []
        for _, data, off in tb.chunks(batches, "body", 2 * tb.CHUNK_BYTES):
            at, code, first, ok = segments_of(data, off, align)
            links, edge = align.links_at(at)
            pairs.append(links)
            counts.append(np.repeat(np.bincount(code[np.repeat(ok, np.diff(first))], minlength=len(at)), np.diff(edge)))
            if sum(map(len, pairs)) > HELD_PAIRS:
                pairs, counts = ([x] for x in summed(pairs, counts))
                if len(pairs[0]) > HELD_PAIRS // 2:
                    yield from emitted(pairs[0], counts[0])
                    pairs, counts = [], []
        yield from emitted(*summed(pairs, counts))

    def summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pair, which = np.unique(np.concatenate([*pairs, np.zeros(0, np.uint32)]), return_inverse=True)
        n = np.bincount(which, np.concatenate([*counts, np.zeros(0, np.int64)]), len(pair)).astype(np.int64)  # exact below 2**53
        return pair[n > 0], n[n > 0]

    def emitted(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + (1 << 16)].astype(np.int64)), pa.array(n[k : k + (1 << 16)])], ["pair", "n"])

    rows = docs.select(docs[text].alias("body"))
    return tb.map_arrow(rows, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: no pair of the same id of B has a larger count."""
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))  # a row an id of B at most


FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, files: Vocabularies, text: str = "text", digest: bool = False, frequent: int = FREQUENT,
    keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, unless ``keep_text``) with ``n_a n_b n_groups n_links n_best count_sum`` (long) and
    ``groups``, the groups written out as ``a1,a2|b1;a3|b2,b3`` (their SHA-256
    if ``digest``, '' staying ''); columns of these names are replaced.

    Two passes over the texts: the first counts the links of each pair of ids
    over the whole corpus; the second aligns again and adds the counts up. Pairs
    with more than 1 / ``frequent`` of all links, fewer than ``frequent``, go to
    all tasks; if there are others, their links are joined with their counts,
    and none of these keys is hot.

    A null or empty text, and one whose joined bytes by either vocabulary are
    not those of a blank and the text, has no tokens: zeros and ''. Equal texts,
    such as those of repeated rows, have equal results; tied counts are all
    best; texts are read whole, some MB at a time; other columns are kept
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*FACTS, "groups")
    counts = durable(with_best(durable(pair_counts(docs, files, text), "pairs")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    often = counts.where(F.col("n") * frequent > (total["n"] or 0))
    top = often.orderBy("pair").toArrow()  # fewer than ``frequent`` rows
    shared = spark.sparkContext.broadcast((files, *(top.column(c).to_numpy() for c in ("pair", "n", "best"))))
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    body = names[text]
    back = [n for n in names.values() if keep_text or n != body]
    fields = [StructField(n, rows.schema[n].dataType) for n in back]
    numbers = [StructField(c, LongType()) for c in FACTS]
    schema = StructType([*fields, *numbers, StructField("groups", StringType()), StructField("rare", ArrayType(IntegerType())), StructField("times",
        ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, pair, n, best = shared.value
        align = aligner(files, True)
        for part, data, off in tb.chunks(batches, body, 2 * tb.CHUNK_BYTES):
            place, code, first, ok = segments_of(data, off, align)
            links, edge = align.links_at(place)
            links = links.astype(np.int64)
            at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
            known = pair[at] == links if len(pair) else np.zeros(len(links), bool)
            told = np.stack([np.where(known, best[at], False).astype(np.int64), np.where(known, n[at], 0)], 1) if len(pair) else np.zeros((len(links), 2), np.int64)
            facts = by_text(np.concatenate([align.facts[place], by_text(told, edge)], 1)[code], first) * ok[:, None]
            bounds, written = first.tolist(), [align.written[k] for k in place.tolist()]
            groups = [b";".join([written[c] for c in code[bounds[i] : bounds[i + 1]].tolist()]) if ok[i] else b"" for i in range(len(ok))]
            if digest:
                groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in groups]
            rare, times = rest(links, known, edge, code, first, ok)
            yield pa.RecordBatch.from_arrays([*part.select(back).columns, *(pa.array(facts[:, k]) for k in range(len(FACTS))), pa.array(groups, pa.binary()).cast(pa.string()),
                rare, times], schema.names)

    def rest(links: np.ndarray, known: np.ndarray, edge: np.ndarray, code: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """For each text its pairs that were not sent, and how often it has each."""
        other = np.flatnonzero(~known)
        mine = np.searchsorted(other, edge)  # bounds of the segments in them
        per = np.diff(mine)[code] * np.repeat(ok, np.diff(first))
        segment = np.repeat(np.arange(len(code)), per)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(per) - per, per) + mine[code[segment]]
        doc = np.searchsorted(first, segment, "right") - 1
        both, times = np.unique(np.stack([doc, links[other[place]]], 1), axis=0, return_counts=True) if len(place) else (np.zeros((0, 2), np.int64), np.zeros(0,
            np.int64))
        bound = pa.array(np.searchsorted(both[:, 0], np.arange(len(ok) + 1)).astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(bound, pa.array(x.astype(np.uint32).view(np.int32)))
        return lists(both[:, 1]), lists(times)

    out = tb.map_arrow(rows, run, schema)
    if top.num_rows < total["rows"]:
        out = _with_rest(out, counts.where(F.col("n") * frequent <= total["n"]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if n in back], *FACTS, "groups")


def _with_rest(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with what their rare pairs add, joined with these pairs' counts."""
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()), "aligned")
    links = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("p"))
    links = links.select("uid", F.col("p.rare").cast("long").bitwiseAND(0xFFFFFFFF).alias("pair"), F.col("p.times").cast("long").alias("times"))
    more = links.join(counts, "pair").groupBy("uid").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"),
        F.col("times")).otherwise(0)).alias("more_best"))
    out = rows.join(more, "uid", "left")
    return out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align(docs, Vocabularies.read(), digest=True, keep_text=False)
    return out.select("doc_id", *FACTS, F.col("groups").alias("groups_sha256"))

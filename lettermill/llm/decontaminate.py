"""Benchmark decontamination: BM25 over test items with block-max WAND."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lettermill.llm import textbytes as tb
from lettermill.session import durable

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.6
SHINGLE = 3
BLOCK = 4
INDEX_BYTES = 8 << 20
HELD_BYTES = 16 << 20
#: What the lists that are looked at second may add to an item, as a part of the threshold: too little to reach it.
NON_ESSENTIAL = 0.8
EPS = 1e-9


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms (letters and digits, A-Z lower-cased), and the texts' n+1 positions."""
    starts, ends, first = tb.word_spans(data, off, tb.NO_TERM)
    return tb.word_hashes(data, starts, ends, lower=True), first


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every ``size`` consecutive terms (of all, if there are fewer)."""
    size = max(1, min(size, len(w)))
    out = np.zeros(max(len(w) - size + 1, 0), np.uint64)
    for k in range(size):
        out = tb.mix64(out * tb.RATIO + w[k : k + len(out)])
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, all before it the question."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _terms_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return terms(raw, np.array([0, len(raw)]))[0]


def cell_size(n_terms: int) -> int:
    """A power of four, 16 at least, that an item fits in: its passages are
    two cells, whatever other items there are."""
    size = 16
    while size < n_terms:
        size *= 4
    return size


@dataclass
class Lists:
    """Inverted lists of the items of one cell size: of every term the items
    that hold it, in order, with their impacts, and the largest impact of each
    block of ``BLOCK`` consecutive items and of the list."""

    cell: int
    items: np.ndarray  # numbers in the index, in order; lists count along these
    term: np.ndarray  # postings, by term and item
    item: np.ndarray
    impact: np.ndarray
    n_terms: int
    threshold: float  # the least that is asked for
    key: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    top: np.ndarray = field(init=False)
    block_key: np.ndarray = field(init=False)
    block_max: np.ndarray = field(init=False)
    essential: tuple = field(init=False)  # of the shorter lists: starts, blocks, maxima, and what the others can add to a block
    whole: tuple = field(init=False)  # the same of all lists

    def __post_init__(self):
        n, size = len(self.items), self.n_terms
        self.blocks = n // BLOCK + 1
        self.key = self.term * (n + 1) + self.item
        self.start = np.searchsorted(self.term, np.arange(size + 1))
        self.top = np.zeros(size)
        np.maximum.at(self.top, self.term, self.impact)
        key = self.term * self.blocks + self.item // BLOCK
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block_key, self.block_max = key[begin], np.maximum.reduceat(self.impact, begin) if len(begin) else self.impact
        df = np.bincount(self.term, minlength=size)
        essential = np.ones(size, bool)
        for cut in (1 << k for k in range(20, -1, -1)):  # the longest lists leave first, as long as no item gets much from them
            trial = df <= cut
            if np.bincount(self.item, self.impact * ~trial[self.term], n).max(initial=0) > NON_ESSENTIAL * self.threshold:
                break
            essential = trial
        rest = np.bincount(self.item, self.impact * ~essential[self.term], n)
        mine = essential[self.block_key // self.blocks]
        blocks = lambda keys, most, rest: (np.searchsorted(keys // self.blocks, np.arange(size + 1)), keys % self.blocks, most, rest)
        self.essential = blocks(self.block_key[mine], self.block_max[mine], np.maximum.reduceat(rest, np.arange(0, n, BLOCK)) if n else rest)
        self.whole = blocks(self.block_key, self.block_max, np.zeros(self.blocks))

    def promising(self, term: np.ndarray, cell: np.ndarray, threshold: float) -> np.ndarray:
        """Passages (by their first cell) with a block of items whose largest
        impacts, over the terms of both cells, reach the threshold. ``term``
        (-1: unknown) and ``cell`` are given for each term of the texts."""
        known = np.flatnonzero(term >= 0)
        found = self._bounded(term[known], cell[known], threshold, self.essential, True)  # repeats of a term add to this bound
        if not len(found):
            return found
        at = [known[np.isin(cell[known] - step, found)] for step in (0, 1)]
        where = np.concatenate([cell[k] - step for step, k in enumerate(at)])
        pair = np.unique(where * self.n_terms + term[np.concatenate(at)])
        return self._bounded(pair % self.n_terms, pair // self.n_terms, threshold, self.whole, False)

    def _bounded(self, term: np.ndarray, where: np.ndarray, threshold: float, lists: tuple, cells: bool) -> np.ndarray:
        """Passages (``cells``: with the terms of the cell behind, too) that
        reach the threshold by sums of block maxima."""
        start, blocks, maxima, rest = lists
        lens = start[term + 1] - start[term]
        term, where, lens = term[lens > 0], where[lens > 0], lens[lens > 0]
        entry = np.repeat(start[term] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        where, block, top = np.repeat(where, lens), blocks[entry], maxima[entry]
        if cells:  # passage k: cells k and k + 1
            where, block, top = np.r_[where, where - 1], np.r_[block, block], np.r_[top, top]
        key = where * self.blocks + block
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return key
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        bound = np.add.reduceat(top[order], begin)
        passage, block = key[begin] // self.blocks, key[begin] % self.blocks
        return np.unique(passage[(bound + rest[block] >= threshold - EPS) & (passage >= 0)])

    def above(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items that a passage of distinct ``terms`` scores ``threshold``
        or more, by block-max WAND.

        The lists stand at their next items. In order of these, the first list
        at which the sum of the lists' largest impacts reaches the threshold
        gives the pivot: no item before it can. If the maxima of the pivot's
        block don't reach it either, all lists up to the pivot skip that block
        (or to the next list's item); else they move to the pivot, and it is
        scored once they all stand there.
        """
        n, out = len(self.items), []
        terms = terms[self.start[terms + 1] > self.start[terms]]
        pos, end, top = self.start[terms].copy(), self.start[terms + 1], self.top[terms]
        while len(terms):
            at = self.item[pos]
            order = np.argsort(at, kind="stable")
            reach = int(np.searchsorted(np.cumsum(top[order]), threshold - EPS))
            if reach == len(order):
                break
            pivot = int(at[order[reach]])
            upto = at <= pivot
            key = terms[upto] * self.blocks + pivot // BLOCK
            found = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            if self.block_max[found][self.block_key[found] == key].sum() < threshold - EPS:
                later = at[~upto]
                aim = min((pivot // BLOCK + 1) * BLOCK, int(later.min()) if len(later) else n)
                move = upto
            elif at[order[0]] == pivot:
                score = float(self.impact[pos[upto]].sum())
                if score >= threshold - EPS:
                    out.append((int(self.items[pivot]), score))
                aim, move = pivot + 1, upto
            else:
                aim, move = pivot, at < pivot
            pos[move] = np.searchsorted(self.key, terms[move] * (n + 1) + aim)
            live = pos < end
            terms, pos, end, top = terms[live], pos[live], end[live], top[live]
        return out


@dataclass
class Index:
    """Inverted index of some items; impacts are divided by the item's own
    score, so that an item scores 1 against itself."""

    ids: list
    vocabulary: np.ndarray  # sorted term hashes
    question: list[np.ndarray]
    answer: list[np.ndarray]
    shingle: list[int]
    lists: list[Lists]


def build_index(rows: list, n_items: int, mean_len: float, df: dict[int, int], threshold: float = THRESHOLD) -> Index:
    """BM25 impacts of a block's items; ``df``, ``n_items`` and ``mean_len``
    are of all items. An item's terms count once each in a query. An item
    without an answer has to overlap as a whole by both measures. The index
    answers for ``threshold`` and above."""
    ids, kept, question, answer, shingle, lens = [], [], [], [], [], []
    for ident, text in rows:
        w = _terms_of(text)
        if not len(w):
            continue
        q, a = question_and_answer(text)
        nq = len(_terms_of(q))
        size = min(SHINGLE, len(w))
        ids.append(ident)
        kept.append(np.unique(w, return_counts=True))
        lens.append(len(w))
        shingle.append(size)
        question.append(np.unique(shingles(w[: max(nq, size)], size)))
        answer.append(np.unique(shingles(w[max(0, nq - size + 1) :], size)) if a and 0 < nq < len(w) else np.unique(shingles(w, size)))
    vocabulary = np.unique(np.concatenate([k[0] for k in kept] + [np.zeros(0, np.uint64)]))
    terms_, impacts = [], []
    for (w, n), size in zip(kept, lens, strict=True):
        d = np.array([df[int(x)] for x in w.view(np.int64)])
        idf = np.log1p((n_items - d + 0.5) / (d + 0.5))
        s = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean_len))
        terms_.append(np.searchsorted(vocabulary, w))
        impacts.append(s / s.sum())
    cells = np.array([cell_size(n) for n in lens], np.int64)
    lists = []
    for cell in np.unique(cells).tolist():
        items = np.flatnonzero(cells == cell)
        term, impact = (np.concatenate([x[k] for k in items]) for x in (terms_, impacts))
        item = np.repeat(np.arange(len(items)), [len(terms_[k]) for k in items])
        order = np.lexsort((item, term))
        lists.append(Lists(cell, items, term[order].astype(np.int64), item[order], impact[order], len(vocabulary), threshold))
    return Index(ids, vocabulary, question, answer, shingle, lists)


def passages(w: np.ndarray, first: np.ndarray, index: Index, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float, int]]:
    """All ``(text, item, score, question, answer, first term)`` that pass.

    An item's passages are two cells of its cell size; the next begins one cell
    later, so every copy lies whole in one. Of a passage that may score the
    threshold for some block of items, all items above it are retrieved, and
    their shingles compared.
    """
    if not len(w) or not len(index.ids):
        return []
    at = np.minimum(np.searchsorted(index.vocabulary, w), len(index.vocabulary) - 1)
    term = np.where(index.vocabulary[at] == w, at, -1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    best: dict[tuple[int, int], tuple] = {}
    for lists in index.lists:
        n_cells = -(-np.diff(first) // lists.cell)
        cell0 = np.r_[0, np.cumsum(n_cells)]
        owner = np.repeat(np.arange(len(n_cells)), n_cells)
        cell = cell0[text] + (np.arange(len(w)) - first[text]) // lists.cell
        for k in lists.promising(term, cell, threshold).tolist():
            t = int(owner[k])
            a = int(first[t]) + (k - int(cell0[t])) * lists.cell
            b = min(a + 2 * lists.cell, int(first[t + 1]))
            have = np.unique(term[a:b])
            seen: dict[int, np.ndarray] = {}
            for i, got in lists.above(have[have >= 0], threshold):
                if (t, i) in best and best[t, i][2] >= got:
                    continue
                size = index.shingle[i]
                if size not in seen:
                    seen[size] = np.unique(shingles(w[a:b], size))
                q, ans = (float(np.isin(s, seen[size]).mean()) for s in (index.question[i], index.answer[i]))
                if q >= QUESTION and ans >= ANSWER:
                    best[t, i] = (t, i, got, q, ans, a - int(first[t]))
    return sorted(best.values())


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``leaks``, an array of ``(item_id, score, question_overlap,
    answer_overlap, first_term)``, the best passage (of equals the first) of
    each leaked item, in order of the items' ids; a column of that name is
    replaced, others are kept whatever their names.

    Statistics are of all items. The index goes to the workers in blocks of
    about ``INDEX_BYTES`` of item text, which only decides how much of it a
    worker holds at a time: every item has its score and its passages whatever
    other items there are. One pass over the documents meets all blocks.
    Passages cover whole texts, very long ones too. A leak scores ``threshold``
    of the item's own score or more and holds enough of the question's and the
    answer's shingles of three terms (of all terms, if there are fewer). Null
    and empty texts, and items without a term, match nothing; repeated items
    and documents each get their rows; an empty table gives an empty result.
    """
    docs = docs.drop("leaks")
    items = items.select(items[item_id].alias("i"), items[item_text].alias("t")).where("t is not null")
    kind = items.schema["i"].dataType
    spark = docs.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in tb.chunks(batches, "t"):
            w, first = terms(data, off)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            once = np.unique(np.stack([doc.astype(np.uint64), w]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[once.view(np.int64), 0]), pa.array(np.r_[np.ones(len(once), np.int64), 0]),
                pa.array(np.r_[np.zeros(len(once), np.int64), len(w)])], ["w", "df", "len"])

    freq = tb.map_arrow(items, listed, "w long, df long, len long").groupBy("w").agg(F.sum("df").alias("df"), F.sum("len").alias("len"))
    freq = durable(freq, "items")
    whole = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    length = freq.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()["len"]
    n, blocks = whole["n"], max(1, -(-whole["b"] // INDEX_BYTES))
    indexes = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == k)
        rows = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))  # about INDEX_BYTES
        mine = np.unique(np.concatenate([_terms_of(t) for _, t in rows] + [np.zeros(0, np.uint64)])).view(np.int64).tolist()
        known = freq if blocks == 1 else freq.join(spark.createDataFrame([(x,) for x in mine], "w long"), "w", "left_semi")
        df = {r["w"]: r["df"] for r in known.select("w", "df").collect()}
        indexes.append(spark.sparkContext.broadcast(build_index(rows, n, max(length / max(n, 1), 1.0), df, threshold)))
    leak = StructType([StructField("item_id", kind), *(StructField(c, DoubleType()) for c in ("score", "question_overlap", "answer_overlap")),
        StructField("first_term", LongType())])
    schema = StructType([*docs.schema.fields, StructField("leaks", ArrayType(leak))])
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), *((c, pa.float64()) for c in leak.names[1:-1]), ("first_term", pa.int64())]))

    def matched(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found: list[dict[int, list]] = [{} for _ in held]
        for shared in indexes:
            index = shared.value
            for (_, w, first), mine in zip(held, found, strict=True):
                for t, i, *values in passages(w, first, index, threshold):
                    mine.setdefault(t, []).append(dict(zip(leak.names, [index.ids[i], *values], strict=True)))
            if len(indexes) > 1:  # one block in memory at a time
                del index, shared._value
        for (part, _, _), mine in zip(held, found, strict=True):
            order = lambda x: (x["item_id"] is None, x["item_id"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(mine.get(t, []), key=order) for t in range(part.num_rows)], arrow)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, data, off in tb.chunks(batches, text):
            held.append((part, *terms(data, off)))
            size += len(data)
            if size >= HELD_BYTES or len(indexes) == 1:
                yield from matched(held)
                held, size = [], 0
        yield from matched(held)

    return tb.map_arrow(docs, run, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

#: Every item against every passage, without an index.
SQL = rf"""
with i0 as (select item_id, {_TERMS.format(t="text")} as w, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from benchmark where text is not null),
i1 as (select *, len(w) as n, regexp_extract(t, '(?s)^(.*[.!?])\s+(.*?)$', 1) as q from i0 where len(w) > 0),
i as (
  select *, len({_TERMS.format(t="q")}) as nq, least(n, 3) as size, greatest(16, (16 * 4 ** ceil(log2(n / 16.0) / 2))::int) as cell from i1),
x as (select item_id, unnest(w) as term, n from i),
df as (select term, count(distinct item_id) as d from x group by term),
stat as (select count(*) as items, greatest(sum(n) / count(*), 1.0) as mean from (select len(w) as n from i0)),
raw as (
  select item_id, term, ln(1 + (items - d + 0.5) / (d + 0.5)) * count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * n / mean)) as s
  from x join df using (term), stat group by item_id, term, n, d, items, mean),
impact as (select item_id, term, s / sum(s) over (partition by item_id) as s from raw),
d0 as (select doc_id, {_TERMS.format(t="coalesce(text, '')")} as w from documents),
d as (select doc_id, w, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from d0),
c as (select distinct cell from i),
place as (select distinct doc_id, cell, (pos // cell - back) * cell as a, term from d, c, range(2) b(back) where pos // cell >= back),
got as (
  select p.doc_id, p.cell, p.a, m.item_id, sum(m.s) as score from place p join impact m using (term) join i on i.item_id = m.item_id and i.cell = p.cell
  group by p.doc_id, p.cell, p.a, m.item_id having sum(m.s) >= 0.5 - 1e-9),
told as (
  select got.*, list_slice(d0.w, a + 1, a + 2 * got.cell) as pw, i.w, i.size, i.nq, i.n from got join d0 using (doc_id) join i using (item_id)),
cut as (
  select *, list_transform(range(1, len(pw) - size + 2), lambda k: array_to_string(list_slice(pw, k, k + size - 1), ' ')) as seen,
    case when nq > 0 then list_slice(w, 1, greatest(nq, size)) else w end as qw,
    case when 0 < nq and nq < n then list_slice(w, greatest(0, nq - size + 1) + 1, n) else w end as aw from told),
parts as (
  select *, list_distinct(list_transform(range(1, len(qw) - size + 2), lambda k: array_to_string(list_slice(qw, k, k + size - 1), ' '))) as qs,
    list_distinct(list_transform(range(1, len(aw) - size + 2), lambda k: array_to_string(list_slice(aw, k, k + size - 1), ' '))) as s from cut),
shares as (
  select *, len(list_intersect(qs, seen)) / len(qs)::double as question_overlap, len(list_intersect(s, seen)) / len(s)::double as answer_overlap from parts),
best as (
  select *, row_number() over (partition by doc_id, item_id order by round(score, 9) desc, a) as k
  from shares where question_overlap >= 0.6 and answer_overlap >= 0.6)
select doc_id, item_id, round(score, 6) as score, round(question_overlap, 6) as question_overlap, round(answer_overlap, 6) as answer_overlap,
  a::bigint as first_term
from best where k = 1
"""

"""Spelling variants: words that differ by one character, and their usual forms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import textbytes as tb
from lettermill.llm.automaton import Automaton
from lettermill.session import durable, shuffle_partitions

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
DAMAGE = 31
#: Words that share a key meet in one automaton; larger groups are parted by longer keys.
MOST_WORDS = 1 << 17
HELD_WORDS = 1 << 19
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs of A-Z, a-z and U+00C0
    to U+00FF (which are the bytes C3 80 to C3 BF), and the texts' bounds in them."""
    solid = LETTER[data]
    solid[1:] |= data[:-1] == 0xC3
    starts, ends, first = tb.word_spans(np.where(solid, 0, 32).astype(np.uint8), off)
    lead = np.r_[0, np.cumsum(data == 0xC3)]
    return starts, ends, ends - starts - (lead[ends] - lead[starts]), first


def taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data`` as an Arrow array, A-Z lower-cased."""
    lens = ends - starts
    off = np.r_[0, np.cumsum(lens)]
    flat = tb.LOWER[data[np.arange(off[-1]) + np.repeat(starts - off[:-1], lens)]]
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat)])


def vocabulary(docs: DataFrame, text: str = "text", ident: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    damage: int = DAMAGE) -> DataFrame:
    """``(word, n)`` of all words of ``least_length`` code points that occur
    ``least_count`` times. Of every run whose CRC-32 behind the id ``damage``
    divides one code point is deleted first (0: of none). Counts are summed in
    each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part, data, off in tb.chunks(batches, "body"):
            starts, ends, length, first = runs(data, off)
            long = np.flatnonzero(length >= least_length)
            words = taken(data, starts[long], ends[long]).dictionary_encode()
            code, first = words.indices.to_numpy(), np.searchsorted(long, first)
            known, cut = words.dictionary.to_pylist(), []
            if damage:
                spoilt = np.zeros(len(code), bool)
                for i, name in enumerate(part.column(0).to_pylist()):
                    seed, crc, mine = zlib.crc32(f"{name}:".encode()), zlib.crc32, code[first[i] : first[i + 1]]
                    sums = np.array([crc(known[c], seed) for c in mine.tolist()], np.int64)
                    hit = np.flatnonzero(sums % damage == 0)
                    spoilt[first[i] + hit] = True
                    for c, h in zip(mine[hit].tolist(), sums[hit].tolist(), strict=True):
                        whole = known[c].decode()
                        at = h % len(whole)
                        if len(whole) > least_length:
                            cut.append((whole[:at] + whole[at + 1 :]).encode())
                code = code[~spoilt]
            n = np.bincount(code, minlength=len(known))
            have = np.flatnonzero(n)
            held.append(pa.table([words.dictionary.take(pa.array(have)).cast(pa.large_string()), pa.array(n[have])], ["word", "n"]))
            held.append(pa.table([pa.array(cut, pa.large_binary()).cast(pa.large_string()), pa.array(np.ones(len(cut), np.int64))], ["word", "n"]))
            rows += len(have) + len(cut)
            if rows > HELD_WORDS:
                table = summed(held)
                held, rows = [table], table.num_rows
                if rows > HELD_WORDS // 2:
                    yield from emitted(held)
                    held, rows = [], 0
        if held:
            yield from emitted([summed(held)])

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def emitted(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in held:
            yield from pa.table([table.column("word").cast(pa.string()), table.column("n")], ["word", "n"]).to_batches(max_chunksize=1 << 16)

    rows = docs.select(docs[ident].alias("ident"), docs[text].alias("body"))
    counts = tb.map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of code points up to U+00FF as one byte for each."""
    data, off = tb.text_bytes(words)
    lead = data == 0xC3
    kept = ~lead
    return np.where(data >= 0x80, data + np.uint8(0x40), data)[kept], np.r_[0, np.cumsum(kept)][off]


def reversed_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    lens = np.diff(off)
    return data[np.repeat(off[:-1] + off[1:] - 1, lens) - np.arange(len(data))]


def some(data: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(off)[which]
    to = np.r_[0, np.cumsum(lens)]
    return data[np.arange(to[-1]) + np.repeat(off[which] - to[:-1], lens)], to


def common_prefix(data: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether words x and y agree in their first ``most`` characters."""
    same, lens = np.ones(len(x), bool), np.diff(off)
    at, d = np.flatnonzero(most > 0), 0
    while len(at):
        inside = (lens[x[at]] > d) & (lens[y[at]] > d)
        px, py = np.minimum(off[x[at]] + d, len(data) - 1), np.minimum(off[y[at]] + d, len(data) - 1)
        ok = inside & (data[px] == data[py])
        same[at[~ok]] = False
        d += 1
        at = at[ok & (most[at] > d)]
    return same


def near_in_table(table: pa.Table) -> pa.Table:
    """``(word, n_near, best_n, best)`` of the words of whole groups (rows as
    ``halves`` makes them) that have a near word in them."""
    words = table.column("word").combine_chunks()
    words = (words if isinstance(words, pa.Array) else words.chunk(0)).dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy()
    data, off = latin(names)
    order = np.argsort(np.asarray(pc.rank(names.cast(pa.binary()), tiebreaker="first")))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[code]  # from here on words are numbered in code-point order
    data, off = some(data, off, order)
    count = np.zeros(len(order), np.int64)
    count[code] = table.column("n").to_numpy()
    column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("size", "head", "tail", "apart")}
    asks, back = np.diff(off)[code] == column["size"], column["tail"] > column["head"]
    queries, found = [], []
    for backward in (False, True):
        mine = np.flatnonzero(asks & (back == backward))
        held = np.unique(code[back == backward])
        if not len(mine):
            continue
        text, edge = some(data, off, held)
        ask, ask_edge = some(data, off, code[mine])
        head, tail = column["head"][mine], column["tail"][mine]
        if backward:  # the automaton of the reversed words, in their order
            text = reversed_words(text, edge)
            turned = pa.Array.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(text)])
            by = pc.sort_indices(turned).to_numpy()
            (text, edge), held = some(text, edge, by), held[by]
            ask = reversed_words(ask, ask_edge)
            head, tail = tail, head
        q, number = Automaton(text, edge).near(ask, ask_edge, head, tail)
        x, y = code[mine[q]], held[number]
        apart = column["apart"][mine[q]]
        new = ~(common_prefix(data, off, x, y, apart) & (apart > 0))  # else the halves before have found it
        queries.append(x[new])
        found.append(y[new])
    x, y = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (queries, found))
    order_ = np.lexsort((y, -count[y], x))
    x, y = x[order_], y[order_]
    lead = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    shown = names.take(pa.array(order)).cast(pa.string())
    return pa.table([shown.take(pa.array(x[lead])), pa.array(np.diff(np.r_[lead, len(x)])), pa.array(count[y[lead]]), shown.take(pa.array(y[lead]))],
        ["word", "n_near", "best_n", "best"])


def halves(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows ``(word, n, size, head, tail, apart)``: for queries of ``size``
    characters (the word's own, one less, one more) the word's first half, and
    its second. An error in one half leaves the other as it is, so near words
    have a half in common. ``apart``: pairs that agree in so many first
    characters have met by the other half."""
    length = F.length("word")
    sizes = F.filter(F.array(length - 1, length, length + 1), lambda s: s >= least_length)
    none = F.lit(0)
    first = lambda s: F.struct(s.alias("size"), F.floor(s / 2).cast("int").alias("head"), none.alias("tail"), none.alias("apart"))
    last = lambda s: F.struct(s.alias("size"), none.alias("head"), (s - F.floor(s / 2).cast("int")).alias("tail"),
        F.floor(s / 2).cast("int").alias("apart"))
    return words.select("word", "n", F.explode(F.concat(F.transform(sizes, first), F.transform(sizes, last))).alias("h")).select("word", "n", "h.*")


def halves_again(rows: DataFrame) -> DataFrame:
    """The rows with half of what lies between head and tail added to either."""
    middle = F.col("size") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    left = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("apart"))
    right = F.struct(F.col("head"), (F.col("tail") + middle - half).alias("tail"), (F.col("head") + half).alias("apart"))
    return rows.select("word", "n", "size", F.explode(F.array(left, right)).alias("h")).select("word", "n", "size", "h.*")


def key() -> Column:
    return F.xxhash64("size", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)"))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most_words: int = MOST_WORDS) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words (``word, n``) that have a
    near one: how many, and the most frequent (of equals the first in
    code-point order).

    Rows that share a half meet. A half that more than ``most_words`` rows
    share is parted again: what lies between holds one error, so half of it is
    exact too, and so on. A task takes some groups at a time and builds two
    automata over their words, of the words as they are and reversed; a query
    walks its half and completes with one error.
    """
    rows, parts = halves(words, least_length).withColumn("k", key()), []
    splits = F.col("size") - F.col("head") - F.col("tail") > 1
    while True:
        crowded = rows.where(splits).groupBy("k").count().where(F.col("count") > most_words).select("k")
        crowded = durable(crowded, "crowded")  # fewer than one for each most_words rows
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(F.broadcast(crowded), "k", "left_anti"))
        rows = halves_again(rows.join(F.broadcast(crowded), "k", "left_semi").where(splits)).withColumn("k", key())
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tb.whole_groups(batches, ["k"]):
            k = table.column("k").to_numpy()
            alone = np.r_[True, k[1:] != k[:-1]] & np.r_[k[1:] != k[:-1], True]
            if not alone.all():
                yield from near_in_table(table.filter(pa.array(~alone))).to_batches()

    dealt = rows.repartition(shuffle_partitions(words.sparkSession), "k").sortWithinPartitions("k")
    found = tb.map_arrow(dealt, run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def variants(words: DataFrame, factor: int = FACTOR, least_length: int = LEAST_LENGTH, most_words: int = MOST_WORDS) -> DataFrame:
    """``words`` (``word, n``; distinct) with ``form`` (the most frequent near
    word, if ``factor`` times as frequent), ``root`` (the end of the chain of
    forms), ``n_near`` and ``form_n``.

    Chains are followed by pointer doubling: each form is ``factor`` times as
    frequent, so a few rounds end all. An empty table gives an empty result.
    """
    near = words.join(near_words(words, least_length, most_words), "word", "left")
    usual = F.col("best_n") >= factor * F.col("n")
    rows = durable(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best")).alias("form"),
        F.when(usual, F.col("best_n")).alias("form_n")), "forms")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step = links.join(on, "root", "left")
        links = durable(step.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    out = rows.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", ident: str = "doc_id", damage: int = 0) -> DataFrame:
    """The words of ``docs`` with their usual spellings, as ``variants`` has them.

    Null and empty texts have no words; a null id is written None in the key of
    ``damage``; repeated rows count as often as they occur; ties go to the first
    word in code-point order. Texts are read whole, a few MB at a time, and
    words of any length are compared; other columns, whatever their names, are
    not read; an empty table gives an empty result.
    """
    return variants(durable(vocabulary(docs, text, ident, damage=damage), "vocabulary"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs, damage=DAMAGE)


SQL = """
with recursive step as (
  select n, list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) t(n)),
crc as (select list(v order by n) as t from step),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
  from documents),
told as (select doc_id, x, count(*) as n from runs where length(x) >= 7 group by all),
b as (select *, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, 'None') || ':' || x)), '..'), lambda h: ('0x' || h)::bigint) as bytes
  from told),
c as (
  select x, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(crc.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) as h from b, crc),
d as (select case when h % 31 = 0 then left(x, h % length(x)) || substr(x, h % length(x) + 2) else x end as word, n from c),
words as (select word, sum(n)::bigint as n from d where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (select word, n, k, left(word, k) || substr(word, k + 2) as cut from (select word, n, unnest(range(length(word))) as k from words)),
near as (
  select a.word, b.word as near, b.n from cuts a join cuts b on a.cut = b.cut and a.k = b.k and a.word <> b.word
  union select cuts.word, words.word, words.n from cuts join words on words.word = cuts.cut
  union select words.word, cuts.word, cuts.n from cuts join words on words.word = cuts.cut),
best as (
  select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by n desc, near) as r from near),
forms as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when best.n >= 10 * words.n then near end as form,
    case when best.n >= 10 * words.n then best.n end as form_n
  from words left join best on best.word = words.word and r = 1),
chain(word, root) as (
  select word, word from forms union all select chain.word, form from chain join forms on forms.word = chain.root where form is not null)
select forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
from forms join chain using (word) join forms f on f.word = chain.root where f.form is null
"""

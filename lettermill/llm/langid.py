"""Language identification by a penalised mixture over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import textbytes as tb

TABLE_BITS = 16
MODEL_BYTES = 64 << 20
SAMPLE_PER_LANG = 4000
ROUNDS = 12
PENALTY = 3.0
UNDETERMINED = "und"
LETTER = r"\p{L}"


def symbols(data: np.ndarray, off: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots of every word (A-Z lower-cased, a blank at either end),
    the position of each word in them, and of each text in the words."""
    starts, ends, first = tb.word_spans(data, off)
    norm, _, ends = tb.joined(data, starts, ends, lower=True)
    b = np.concatenate([[32, 32], norm, [32]]).astype(np.uint64)  # a word's first trigram begins before it
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    slot = (code * tb.RATIO) >> np.uint64(64 - bits)
    # one slot for each byte of a word, in the middle of its trigram; none about the blank that parts words (and texts)
    slot = slot[1 : len(norm) + 1][norm != 32].astype(np.int64)
    return slot, np.r_[0, ends - np.arange(len(ends))].astype(np.int64)[: len(ends)], first


def count_slots(rows: DataFrame, bits: int) -> DataFrame:
    """``number, body`` -> ``(number, slot, n)`` over all rows, partly summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, data, off in tb.chunks(batches, "body"):
            slot, words, first = symbols(data, off, bits)
            edge = np.r_[words, len(slot)][first]
            for i, number in enumerate(part.column(0).to_pylist()):
                if edge[i + 1] > edge[i]:
                    sums.setdefault(number, np.zeros(1 << bits, np.int64))[:] += np.bincount(slot[edge[i] : edge[i + 1]], minlength=1 << bits)
        for number, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number), pa.int32()), pa.array(at), pa.array(n[at])], ["number", "slot", "n"])

    return tb.map_arrow(rows.select("number", "body"), run, "number int, slot long, n long").groupBy("number", "slot").agg(F.sum("n").alias("n"))


def table_bits(n_langs: int) -> int:
    """Trigram slots of each language: 2**16, and fewer where there are more
    than 256 languages, so that no model takes more than ``MODEL_BYTES``."""
    bits = min(TABLE_BITS, (MODEL_BYTES // 4 // max(n_langs, 1)).bit_length() - 1)
    if bits < 8:
        raise ValueError(f"{n_langs} labels are more than a model can hold: is this the column of languages?")
    return bits


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a float32 table of log P(slot | language).

    Learns from about ``sample_per_lang`` labelled texts of each language (the
    documented bound), chosen by a hash of the text, so that repeated rows are
    learned from together or not at all. The model's size depends on the number
    of languages alone (see ``table_bits``). Null texts and labels, and the
    order of rows, teach nothing; an empty table gives a model of no language.
    """
    rows = train.select(train[lang].alias("lang"), train[text].alias("body")).where("lang is not null and body is not null")
    have = rows.groupBy("lang").count()
    most = MODEL_BYTES // 4 >> 8
    counts = {r["lang"]: r["count"] for r in have.limit(most + 1).collect()}  # a row a language, refused if too many
    bits = table_bits(len(counts))
    if not counts:
        return [], np.zeros((1 << bits, 0), np.float32)
    names = sorted(counts)
    known = [(k, i, min(1.0, sample_per_lang / counts[k])) for i, k in enumerate(names)]
    numbered = train.sparkSession.createDataFrame(known, "lang string, number int, share double")
    drawn = F.pmod(F.xxhash64("body"), F.lit(1 << 30)) / float(1 << 30)
    found = count_slots(rows.join(F.broadcast(numbered), "lang").where(drawn < F.col("share")), bits).toArrow()  # at most a row a slot
    table = np.full((1 << bits, len(names)), 0.5)
    table[found.column("slot").to_numpy(), found.column("number").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32)


def across(r: np.ndarray) -> np.ndarray:
    """Sums of short rows, by columns: faster than along the rows."""
    out = r[:, 0].copy()
    for k in range(1, r.shape[1]):
        out += r[:, k]
    return out


def expectation(p: np.ndarray, begin: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the ``allowed`` languages in each text, whose words begin at
    ``begin``, and the log likelihood of the words ``p`` under them."""
    doc = np.repeat(np.arange(len(begin)), count)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = share[doc]
        r *= p
        r /= across(r)[:, None]
        share = np.add.reduceat(r, begin, axis=0) / count[:, None]
    return share, np.add.reduceat(np.log(across(share[doc] * p)), begin)


def shortfall(p: np.ndarray, begin: np.ndarray, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How much more log likelihood than under ``share`` there can be at most:
    it is concave, so its steepest slope to a single language bounds it."""
    slope = p / across(share[np.repeat(np.arange(len(begin)), count)] * p)[:, None]
    return np.maximum(np.add.reduceat(slope, begin, axis=0).max(1) - count, 0.0)


def infer(data: np.ndarray, off: np.ndarray, table: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each text the most frequent language of its chosen set and that
    language's share of its words; -1 for a text without words.

    A word is one draw from the mixture. Expectation-maximisation over all
    languages ranks them by share; then sets of the 1, 2, ... first languages,
    up to all of them, are fitted where they can still gain, and the set with the largest log likelihood less ``penalty`` *
    log(words) for each language wins. Of equal shares the first language in
    order leads.
    """
    n, langs = len(off) - 1, table.shape[1]
    best, score = np.full(n, -1), np.zeros(n)
    slot, words, first = symbols(data, off, len(table).bit_length() - 1)
    if not len(words) or not langs:
        return best, score
    loglik = np.add.reduceat(table[slot], words, axis=0).astype(np.float64)
    top = loglik.max(1, keepdims=True)
    p = np.exp(np.maximum(loglik - top, -60.0))
    count = np.diff(first)
    full = np.flatnonzero(count)
    begin, count = first[:-1][full], count[full]
    single = np.add.reduceat(np.log(p), begin, axis=0)
    share, mixed = expectation(p, begin, count, np.ones((len(full), langs)), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    lead = np.where(single.max(1) > single[np.arange(len(full)), order[:, 0]], single.argmax(1), order[:, 0])
    order = np.take_along_axis(order, np.argsort(order != lead[:, None], axis=1, kind="stable"), 1)  # the lead first, the others as they were
    cost = penalty * np.log(count + 1)
    value = single[np.arange(len(full)), lead] - cost
    chosen = np.zeros((len(full), langs))
    chosen[np.arange(len(full)), lead] = 1.0
    # no set can gain more than all languages do at best, so most texts need no second one
    bound = mixed + shortfall(p, begin, count, share)
    for size in range(2, langs + 1):
        open_ = np.flatnonzero(bound - size * cost > value)
        if not len(open_):
            break
        words = np.repeat(np.isin(np.arange(len(full)), open_), count)
        part, n_words = p[words], count[open_]
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :size], 1.0, 1)
        fitted, got = expectation(part, np.cumsum(n_words) - n_words, n_words, allowed, rounds)
        got = got - size * cost[open_]
        better = got > value[open_]
        value[open_] = np.where(better, got, value[open_])
        chosen[open_[better]] = fitted[better]
    best[full], score[full] = chosen.argmax(1), chosen.max(1)
    return best, np.clip(score, 0.0, 1.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (that language's share of the
    text's words); columns of those names are replaced.

    Reads the text alone. A null text, and one without a letter, is ``und``
    with score 0, as is every text if no language was learned. Equal texts, such
    as those of repeated rows, have equal results; of languages with equal
    shares the first in order is predicted. Texts are processed whole, a few MB
    at a time; other columns are kept whatever their names; an empty table gives
    an empty result.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names, table = model
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(table)  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, text):
            best, score = infer(data, off, shared.value, penalty)
            letter = pc.fill_null(pc.match_substring_regex(part.column(part.schema.get_field_index(text)), LETTER), False).to_numpy(zero_copy_only=False)
            ok = letter & (best >= 0)
            pred = [names[b] if o else UNDETERMINED for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0))], schema.names)

    return tb.map_arrow(docs, run, schema)


def fold(ident: str, k: int) -> Column:
    """CRC-32 of the id as text, modulo ``k``."""
    return F.pmod(F.crc32(F.col(ident).cast("string").cast("binary")), F.lit(k))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held))
    rows = identify(docs.select("doc_id", "text", held.alias("held_out")).select("doc_id", "held_out", "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score")

"""Quality of texts by weak supervision: rules that vote or abstain, and what
expectation-maximisation makes of how far each can be trusted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lettermill.llm import textbytes as tb
from lettermill.session import durable

ROUNDS = 200
SETTLED = 1e-9
SMOOTHING = 1.0
KEEP = 0.5


def _bytes(*chars: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _bytes(*b"#*$%&|<>")
LETTER = _bytes(*range(65, 91), *range(97, 123), *range(0xC3, 256))  # of other scripts, too: by their first bytes
CAPITAL = _bytes(*range(65, 91))
STOP = _bytes(*b".!?")
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_stops", "n_shouts", "n_lettered",
    "n_short"]


@dataclass(frozen=True)
class Rule:
    """Votes for a text where ``good`` holds, against it where ``bad`` does
    (SQL over the columns of ``measure``), and abstains elsewhere."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), 2).when(F.expr(self.good), 1).otherwise(0)


RULES = [
    Rule("length", "n_words between 50 and 100000", "n_words < 20"),
    Rule("word size", "word_chars between 3 * n_words and 9 * n_words and n_words > 0", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words and n_words > 0", "10 * n_symbols > n_words"),
    Rule("repeated lines", "20 * n_dup_lines <= n_lines and n_lines > 1", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated words", "20 * n_repeat_words <= n_words and n_words >= 20", "10 * n_repeat_words > 3 * n_words"),
    Rule("capitals", "10 * n_capitals <= n_letters and n_letters > 0", "10 * n_capitals > 3 * n_letters"),
    Rule("lettered words", "100 * n_lettered >= 95 * n_words and n_words > 0", "10 * n_lettered < 8 * n_words"),
    Rule("short words", "100 * n_short between 15 * n_words and 75 * n_words and n_words >= 20", "100 * n_short < 5 * n_words and n_words >= 20"),
    Rule("sentences", "n_stops > 0 and n_words between 4 * n_stops and 60 * n_stops", "n_words >= 50 and (n_words > 200 * n_stops or n_words < 2 * n_stops)"),
    Rule("shouting", "200 * n_shouts <= n_words and n_words > 0", "20 * n_shouts > n_words"),
]


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][off])


def numbered(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Equal numbers for equal spans of ``data`` between neighbouring edges."""
    spans = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated_words(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text how many words stand in a window of three that its words
    hold twice or more. ``code``: numbers of the words."""
    n = len(code)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(n - 2, 0))
    at = at[doc[at] == doc[at + 2]]
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    kinds = int(code.max()) + 1
    _, pair = np.unique((doc[at] * kinds + code[at]) * kinds + code[at + 1], return_inverse=True)
    _, which, times = np.unique(pair * kinds + code[at + 2], return_inverse=True, return_counts=True)
    hit = at[times[which] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[hit + k] = True
    return per_text(covered, first)


def repeated_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines with a word, and those equal to an earlier one."""
    n = len(off) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    ends = np.flatnonzero(out == 10) + 1  # every text ends its last line
    edge = np.r_[0, ends]
    doc = np.searchsorted(off[1:] + np.arange(1, n + 1), ends)
    worded = per_text(~tb.SPACE[out], edge) > 0
    code, doc = numbered(out, edge)[worded], doc[worded]
    if not len(code):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, first = np.unique(doc * (code.max() + 1) + code, return_index=True)
    lines = np.bincount(doc, minlength=n)
    return lines, lines - np.bincount(doc[first], minlength=n)


def stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``STATS`` of each text, a row for each."""
    starts, ends, first = tb.word_spans(data, off)
    points = np.r_[0, np.cumsum(FIRST_BYTE[data])]
    letters = np.r_[0, np.cumsum(LETTER[data])]
    norm, to, _ = tb.joined(data, starts, ends)
    code = numbered(norm, np.r_[to, len(norm)]) if len(to) else np.zeros(0, np.int64)
    lines, again = repeated_lines(data, off)
    lettered = letters[ends] > letters[starts]
    short = lettered & (points[ends] - points[starts] <= 3)
    count = lambda kind: per_text(kind[data], off)
    return np.stack([np.diff(first), per_text(FIRST_BYTE[data] & ~tb.SPACE[data], off), count(SYMBOL), again, repeated_words(code, first), lines,
        count(LETTER), count(CAPITAL), count(STOP), count(_bytes(*b"!")), per_text(lettered, first), per_text(short, first)], 1).astype(np.int64)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``STATS`` (columns of these names are replaced). A null
    text is like an empty one: zeros."""
    docs = docs.drop(*STATS)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, text):
            found = stats(data, off)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATS)))], schema.names)

    return tb.map_arrow(docs, run, schema)


@dataclass(frozen=True)
class Model:
    """``good``: how many texts are; ``votes[rule][class][vote]``: how often a
    rule abstains (0), votes for (1) and against (2) texts that are bad (class 0)
    and good (class 1)."""

    good: float
    votes: np.ndarray

    def weight(self, rule: int, vote: int) -> float:
        return float(np.log(self.votes[rule, 1, vote] / self.votes[rule, 0, vote]))

    def accuracy(self, rule: int) -> tuple[float, float]:
        """How often a vote of the rule is right on bad texts, and on good ones, when it does not abstain."""
        bad, good = self.votes[rule]
        return float(bad[2] / (bad[1] + bad[2])), float(good[1] / (good[1] + good[2]))


def ballots(rules: list[Rule]) -> Column:
    """All votes as one number, a digit to the base of three for each rule."""
    return reduce(lambda sum_, rule: sum_ * 3 + rule.vote(), rules, F.lit(0).cast("long"))


def fit(measured: DataFrame, rules: list[Rule] = RULES, rounds: int = ROUNDS) -> Model:
    """Learn from the votes on all rows, without labels.

    Spark counts the rows of each ballot; there are 3 ** rules ballots at most
    (59,049 of ten), whatever the number of rows, and the driver repeats over
    these: the expectation of each ballot's class, then the frequencies of each
    rule's votes in both classes (one row is added to each). It starts from the
    guess that texts with no vote against them are good, and those with two are
    not. Null columns make a rule abstain; no rows leave that guess's prior.
    """
    counted = measured.groupBy(ballots(rules).alias("ballot")).agg(F.count("*").alias("n")).orderBy("ballot").toArrow()
    ballot, n = counted.column("ballot").to_numpy(), counted.column("n").to_numpy().astype(np.float64)
    return expectation_maximisation(ballot, n, len(rules), rounds)


def expectation_maximisation(ballot: np.ndarray, n: np.ndarray, n_rules: int, rounds: int = ROUNDS) -> Model:
    digit = np.stack([ballot // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)], 1)
    good = np.array([0.95, 0.5, 0.05])[np.minimum((digit == 2).sum(1), 2)]
    chosen = digit[:, :, None] == np.arange(3)
    while True:
        share = (n @ good + SMOOTHING) / (n.sum() + 2 * SMOOTHING)
        votes = np.stack([np.einsum("i,ijv->jv", n * q, chosen) + SMOOTHING for q in (1 - good, good)], 1)
        votes /= votes.sum(2, keepdims=True)
        logit = np.log(share / (1 - share)) + np.einsum("ijv,jv->i", chosen, np.log(votes[:, 1] / votes[:, 0]))
        new, rounds = 1 / (1 + np.exp(-logit)), rounds - 1
        if rounds <= 0 or not len(n) or np.abs(new - good).max() < SETTLED:
            return Model(float(share), votes)
        good = new


def judge(measured: DataFrame, model: Model, rules: list[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """``measured`` with ``votes`` (+1, 0 and -1 by rule), ``quality`` (the
    posterior probability that the text is good), ``base_failed`` and ``kept``."""
    names = ["votes", "quality", "base_failed", "kept"]
    weight = [F.element_at(F.array(*[F.lit(model.weight(j, v)) for v in range(3)]), rule.vote() + 1) for j, rule in enumerate(rules)]
    logit = reduce(lambda a, b: a + b, weight, F.lit(float(np.log(model.good / (1 - model.good)))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = F.array(*[F.element_at(F.array(F.lit(0), F.lit(1), F.lit(-1)), r.vote() + 1) for r in rules])
    out = measured.drop(*names).withColumns({"votes": votes, "quality": 1 / (1 + F.exp(-logit)), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def quality(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``STATS``, ``votes``, ``quality``, ``base_failed`` and
    ``kept``; columns of these names are replaced, others kept.

    The rules' trust is learned from all of ``docs``. Null, empty and blank
    texts have no words and fail; equal texts, such as those of repeated rows,
    have equal results; a quality at the limit is kept; texts are measured
    whole, some MB at a time; an empty table gives an empty result.
    """
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    model = fit(measure(rows.select(names[text]), names[text]), rules)
    out = judge(measure(rows, names[text]), model, rules)
    new = [*STATS, "votes", "quality", "base_failed", "kept"]
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in new], *new)


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    measured = durable(measure(docs).drop("text"), "measured")
    return judge(measured, fit(measured)).select(*BASE)


def _sql() -> str:
    """The same in SQL: the rounds are a recursive query over one row of lists."""
    n = len(RULES)
    digits = ", ".join(f"(ballot // {3 ** (n - 1 - j)}) % 3" for j in range(n))
    ballot = "0"
    for rule in RULES:
        ballot = f"({ballot}) * 3 + case when {rule.bad} then 2 when {rule.good} then 1 else 0 end"
    of = r"regexp_replace(t, '[^{}]', '', 'g')"
    letter = r"A-Za-z\x{C0}-\x{10FFFF}"
    told = "list_sum(list_transform(range(1, len(ns) + 1), lambda i: case when ds[i][j] = v then ns[i] * {} else 0 end))"
    good, bad = told.format("good[i]"), told.format("(1 - good[i])")
    return rf"""
with recursive d as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from d),
win as (select id, i, md5(array_to_string(list_slice(w, i, i + 2), chr(1))) as h from (select id, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select id, i from (select *, count(*) over (partition by id, h) as n from win) where n > 1),
again as (select id, count(distinct i + k) as n from twice, range(3) t(k) group by id),
m as (
  select id, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length({of.format('#*$%&|<>')})::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls) as n_lines,
    length({of.format(letter)}) as n_letters, length({of.format('A-Z')}) as n_capitals, length({of.format('.!?')}) as n_stops,
    length({of.format('!')}) as n_shouts, len(list_filter(w, lambda x: regexp_matches(x, '[{letter}]'))) as n_lettered,
    len(list_filter(w, lambda x: regexp_matches(x, '[{letter}]') and length(x) <= 3)) as n_short
  from w left join again using (id)),
b as (select *, {ballot} as ballot from m),
c as (select ballot, count(*)::double as n, [{digits}] as d from b group by ballot),
l as (select list(ballot order by ballot) as bs, list(n order by ballot) as ns, list(d order by ballot) as ds, sum(n) as total from c),
em(round, good) as (
  select 0, list_transform(ds, lambda d: [0.95, 0.5, 0.05][least(len(list_filter(d, lambda v: v = 2)), 2) + 1]) from l
  union all
  select round + 1, list_transform(range(1, len(ns) + 1), lambda i: 1 / (1 + exp(-(ln(prior / (total + 2 - prior))
    + list_sum(list_transform(range(1, {n + 1}), lambda j: weights[j][ds[i][j] + 1]))))))
  from (select round, ns, ds, total, list_dot_product(ns, good) + 1 as prior, list_transform(range(1, {n + 1}), lambda j: list_transform(range(3),
      lambda v: ln(({good} + 1) / (list_dot_product(ns, good) + 3)) - ln(({bad} + 1) / (total - list_dot_product(ns, good) + 3)))) as weights
    from em, l where round < {ROUNDS})),
q as (select unnest(bs) as ballot, unnest(good) as q from em, l where round = {ROUNDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and q >= {KEEP} as kept
from (select b.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed, q from b join q using (ballot))
"""


SQL = _sql()

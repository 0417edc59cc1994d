import math
import re
from collections import Counter

import numpy as np
import pytest

from lettermill.llm import quality
from tests.llm.conftest import DATA, EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    letter = lambda c: c.isascii() and c.isalpha() or c >= "À"
    lettered = [w for w in words if any(map(letter, w))]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines),
        sum(map(letter, text)), sum("A" <= c <= "Z" for c in text), sum(c in ".!?" for c in text), text.count("!"), len(lettered),
        sum(len(w) <= 3 for w in lettered)]


def brute_kept(votes, rounds=quality.ROUNDS):
    """Posterior probabilities row by row, without ballots."""
    n_rules = len(votes[0])
    q = [(0.95, 0.5, 0.05)[min(v.count(2), 2)] for v in votes]
    for _ in range(rounds):
        total = sum(q)
        share = (total + 1) / (len(q) + 2)
        table = [[[1.0] * 3, [1.0] * 3] for _ in range(n_rules)]
        for v, p in zip(votes, q, strict=True):
            for j, x in enumerate(v):
                table[j][1][x] += p
                table[j][0][x] += 1 - p
        weight = [[math.log(g / sum(good)) - math.log(b / sum(bad)) for b, g in zip(bad, good, strict=True)] for bad, good in table]
        q = [1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(weight[j][x] for j, x in enumerate(v))))) for v in votes]
    return q


def test_op12_equals_brute_force(spark, texts):
    measured = quality.measure(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = quality.judge(measured, quality.fit(measured)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [r[c] for c in quality.STATS] == brute_stats(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    digit = {0: 0, 1: 1, -1: 2}
    want = brute_kept([[digit[v] for v in r.votes] for r in rows])
    assert all(abs(r.quality - q) < 1e-6 for r, q in zip(rows, want, strict=True))
    kept = {r.doc_id: r.kept for r in rows}
    assert kept == {r.doc_id: q >= 0.5 and not r.base_failed for r, q in zip(rows, want, strict=True)}
    assert {r.doc_id: r.kept for r in quality.op12_quality(spark, DATA).collect()} == kept


def test_labels_that_it_never_sees(spark):
    """Against labels of the larger table: good texts stay, bad ones go."""
    folder = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "good").dropDuplicates(["doc_id"])
    rows = quality.op12_quality(spark, folder).join(labels, "doc_id").collect()
    good = [r for r in rows if r.good == 1 and not r.base_failed]
    bad = [r for r in rows if r.good == 0]
    assert len(good) > 200 and sum(r.kept for r in good) >= 0.98 * len(good)
    assert len(bad) > 30 and sum(r.kept for r in bad) <= 0.02 * len(bad)


@pytest.mark.parametrize("seed", range(3))
def test_accuracies_are_found(seed):
    """Votes drawn with known accuracies: the model finds them and the classes."""
    draw = np.random.default_rng(seed)
    n, right, abstains = 40_000, [0.95, 0.9, 0.85, 0.8, 0.9], [0.1, 0.5, 0.3, 0.2, 0.0]
    good = draw.random(n) < 0.8
    votes = np.zeros((n, 5), int)
    for j in range(5):
        said = np.where(draw.random(n) < right[j], good, ~good)
        votes[:, j] = np.where(draw.random(n) < abstains[j], 0, np.where(said, 1, 2))
    ballot, times = np.unique(votes @ 3 ** np.arange(4, -1, -1), return_counts=True)
    model = quality.expectation_maximisation(ballot, times.astype(float), 5)
    assert abs(model.good - 0.8) < 0.02
    for j in range(5):
        assert max(abs(x - right[j]) for x in model.accuracy(j)) < 0.04
    score = np.log(model.good / (1 - model.good)) + sum(np.array([model.weight(j, v) for v in range(3)])[votes[:, j]] for j in range(5))
    assert ((score >= 0) == good).mean() > 0.95


def test_edge_cases(spark, edges, nothing):
    out = quality.quality(edges)
    new = {*quality.STATS, "votes", "quality", "base_failed", "kept"}
    rows = out.collect()
    assert set(out.columns) == {*edges.columns, *new} and len(rows) == len(EDGES)
    want = Counter((e[0], tuple(brute_stats(e[1]))) for e in EDGES)
    assert Counter((r.doc_id, tuple(r[c] for c in quality.STATS)) for r in rows) == want
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality.quality(nothing).count() == 0


def test_very_long_text(spark):
    long = ("One two three.\n" + " ".join(f"w{k % 1000}" for k in range(500)) + "\n") * 1200
    assert len(long) > 2_000_000
    rows = quality.measure(spark.createDataFrame([(1, long), (2, "a b c a b c\n\na b c"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: [r[c] for c in quality.STATS] for r in rows} == {1: brute_stats(long), 2: brute_stats("a b c a b c\n\na b c"), 3: [0] * 12}

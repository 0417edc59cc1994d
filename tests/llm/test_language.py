import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lettermill.llm import kneserney, langid
from tests.llm.conftest import DATA, EDGES

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = langid.op7_langid(spark, DATA).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def brute_languages(train, texts, penalty=3.0, rounds=12):
    """Language and share of each text, one text after the other, from the words."""
    slots = 1 << 16
    counts = {}

    def trigrams(word):
        padded = b" " + word + b" "
        codes = [padded[k : k + 3] for k in range(len(padded) - 2)]
        return [(int.from_bytes(c, "big") * 0x9E3779B97F4A7C15 % 2**64) >> 48 for c in codes]

    def words_of(text):
        return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))

    for text, lang in train:
        if text is not None and lang is not None:
            mine = counts.setdefault(lang, Counter())
            for w in words_of(text):
                mine.update(trigrams(w))
    names = sorted(counts)
    total = [sum(counts[n].values()) + 0.5 * slots for n in names]
    logs = lambda w: [sum(math.log((counts[n][t] + 0.5) / total[k]) for t in trigrams(w)) for k, n in enumerate(names)]
    known = {}
    out = []
    for text in texts:
        words = words_of(text)
        if not words or not re.search(r"[^\W\d_]", text) or not names:
            out.append(("und", 0.0))
            continue
        p = []
        for w in words:
            if w not in known:
                row = logs(w)
                known[w] = [math.exp(max(x - max(row), -60.0)) for x in row]
            p.append(known[w])

        def mixture(allowed, p=p):
            share = {k: 1 / len(allowed) for k in allowed}
            for _ in range(rounds):
                sums = dict.fromkeys(allowed, 0.0)
                for row in p:
                    z = sum(share[k] * row[k] for k in allowed)
                    for k in allowed:
                        sums[k] += share[k] * row[k] / z
                share = {k: v / len(p) for k, v in sums.items()}
            return share, sum(math.log(sum(share[k] * row[k] for k in allowed)) for row in p)

        single = [sum(math.log(row[k]) for row in p) for k in range(len(names))]
        share, _ = mixture(range(len(names)))
        order = sorted(share, key=lambda k: (-share[k], k))
        if max(single) > single[order[0]]:
            lead = single.index(max(single))
            order = [lead, *(k for k in order if k != lead)]
        cost = penalty * math.log(len(words) + 1)
        best, value = {order[0]: 1.0}, single[order[0]] - cost
        for size in range(2, len(names) + 1):
            fitted, got = mixture(order[:size])
            if got - size * cost > value:
                best, value = fitted, got - size * cost
        lead = max(sorted(best), key=lambda k: best[k])
        out.append((names[lead], best[lead]))
    return out


def test_languages_against_brute_force(spark):
    """Texts of one language, mixtures and odd ones, from a model of few texts."""
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text]
    train = [(r.text, r.lang) for r in rows[:60]] + [(None, "en"), ("lost words", None)]
    short = [" ".join(r.text.split()[:60]) for r in rows[60:120]]
    texts = [*short, *(f"{a} {b}" for a, b in zip(short, short[7:])), *(f"{a} {b} {c}" for a, b, c in zip(short[::3], short[1::3], short[2::3])), "x",
        "12 34", "", None, " \n", "Ω ж"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string").repartition(3))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, model).collect()}
    want = brute_languages(train, texts)
    assert len({w[0] for w in want}) == 5 and sum(w[1] < 0.95 for w in want if w[0] != "und") > 20
    for k, (name, score) in enumerate(want):
        assert got[k][0] == name and abs(got[k][1] - score) < 1e-3, (k, got[k], want[k])  # the table is in single precision


def test_the_model_is_bounded_whatever_the_labels(spark):
    assert [langid.table_bits(n) for n in (0, 4, 256, 257, 6000, 65536)] == [16, 16, 16, 15, 11, 8]
    with pytest.raises(ValueError, match="labels"):
        langid.table_bits(65537)
    frame = spark.range(3000).selectExpr("concat('word', id) as text", "concat('l', id) as lang")
    names, table = langid.fit(frame)
    assert len(names) == 3000 and table.nbytes <= langid.MODEL_BYTES
    assert {r.lang_pred for r in langid.identify(frame.where("lang = 'l7'"), (names, table)).collect()} <= set(names)


def test_mixtures(documents, texts):
    model = langid.fit(documents)
    by = {}
    for r in documents.collect():
        if 1000 < len(r.text) < 4000:
            by.setdefault(r.lang, r.text)
    a, b = by["en"], by["de"]
    part = b[: len(a) // 3]
    frame = documents.sparkSession.createDataFrame([(f"{a} {part}",), (a,), (b,)], "text string").coalesce(1)
    mixed, pure, other = langid.identify(frame, model).collect()
    assert mixed.lang_pred == "en" and 0.6 < mixed.score < 0.9
    assert (pure.lang_pred, other.lang_pred) == ("en", "de") and min(pure.score, other.score) > 0.95


def test_a_text_in_four_languages(documents):
    by = {}
    for r in documents.collect():
        if r.lang and len(r.text.split()) > 150:
            by.setdefault(r.lang, r.text)
    assert len(by) == 4
    frame = documents.sparkSession.createDataFrame([(" ".join(" ".join(t.split()[:150]) for t in by.values()),)], "text string")
    assert 0.24 < langid.identify(frame, langid.fit(documents)).collect()[0].score < 0.29


def test_language_of_edge_cases(edges, nothing):
    out = langid.identify(edges, langid.fit(edges))
    rows = out.collect()
    assert len(rows) == len(EDGES) and set(edges.columns) <= set(out.columns)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    assert {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    empty = langid.fit(nothing)
    assert empty[0] == [] and {r.lang_pred for r in langid.identify(edges, empty).collect()} == {"und"}
    assert langid.identify(nothing, empty).count() == 0


def brute_scores(train, texts, order=2):
    """From the counts of whole n-grams; lower orders count distinct words before."""
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) + ["END"]
    docs = [tokens(t) for t in train]
    single = Counter(w for d in docs for w in d)
    grams = {order: Counter(tuple(p[k : k + order]) for d in docs for p in [["BEGIN"] * (order - 1) + d] for k in range(len(d)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    n, v = sum(single.values()), len(single)
    d = {k: kneserney.discounts([sum(c == x for c in grams[k].values()) for x in (1, 2, 3, 4)]) for k in grams}
    context = defaultdict(lambda: [0, 0, 0, 0])
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            context[g[:-1]][0] += c
            context[g[:-1]][min(c, 3)] += 1
    t = sum(grams[1].values())
    rest = sum(d[1][min(c, 3) - 1] for c in grams[1].values()) / t if t else 1.0

    def after(*g):
        c = grams[len(g)].get(g, 0)
        less = c - d[len(g)][min(c, 3) - 1] if c else 0
        if len(g) == 1:
            return (less / t if c else 0) + rest / (v + 1)
        if g[:-1] not in context:
            return after(*g[1:])
        x = context[g[:-1]]
        return (less + sum(d[len(g)][k] * x[k + 1] for k in range(3)) * after(*g[1:])) / x[0]

    if single:  # probabilities of all words and an unknown one add up to one
        for a in ((), max((c for c in context if len(c) == 1), key=lambda c: context[c][0]), max((c for c in context if len(c) == order - 1),
            key=lambda c: context[c][0])):
            assert sum(after(*a, w) for w in single) + after(*a, "?") == pytest.approx(1)
    out = []
    for text in texts:
        w = tokens(text)
        p = ["BEGIN"] * (order - 1) + w
        logs = sum(math.log10(after(*p[k : k + order])) for k in range(len(w)))
        out.append((len(w), sum(x in single for x in w), n, sum(math.log10((single.get(x, 0) + 1) / (n + v + 1)) for x in w), logs))
    return out


NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def same(rows, want):
    for r, w in zip(rows, want, strict=True):
        assert tuple(r[c] for c in NAMES[:3]) == w[:3] and [r[c] for c in NAMES[3:]] == pytest.approx(w[3:], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_documents(spark, texts, order, monkeypatch):
    monkeypatch.setattr(kneserney.train_model, "__defaults__", ("text", order))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    rows = {r.doc_id: r for r in kneserney.op10_kneserney(spark, DATA).collect()}
    same([rows[i] for i in texts], brute_scores([t for i, t in texts.items() if not held[i]], texts.values(), order))
    assert all(rows[i].held_out == held[i] for i in texts)
    assert sum(rows[i].score for i in texts if held[i]) > sum(rows[i].base_score for i in texts if held[i])


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_edge_cases(edges, nothing, order):
    train = [r[1] for r in EDGES]
    rows = sorted(kneserney.score(edges, kneserney.train_model(edges, order=order)).collect(), key=lambda r: str((r.doc_id, r.text)))
    same(rows, brute_scores(train, [r.text for r in rows], order))
    untrained = kneserney.train_model(nothing, order=order)
    same(rows := kneserney.score(edges, untrained).collect(), brute_scores([], [r.text for r in rows], order))
    assert kneserney.score(nothing, untrained).count() == 0
    with pytest.raises(ValueError, match="order"):
        kneserney.train_model(nothing, order=4)

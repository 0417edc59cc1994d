import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lettermill.llm import spelling
from lettermill.llm.automaton import Automaton
from tests.llm.conftest import DATA, EDGES


def brute_variants(n, factor=10):
    """Rows for the words of the counter ``n``, by what is left of them without one character."""
    by, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            by[w[:k], w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(rows)


def brute_words(texts, damage=31):
    n = Counter()
    for ident, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{ident}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def flat(words):
    raw = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def differ_by_one(x, y, head, tail):
    if not (y.startswith(x[:head]) and len(y) >= head + tail and y[len(y) - tail :] == x[len(x) - tail :]):
        return False
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


@pytest.mark.parametrize("seed", range(60))
def test_automaton_numbers_words_and_finds_near_ones(seed):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 60))})
    data, off = flat(words)
    made = Automaton(data, off)
    assert made.number(data, off).tolist() == list(range(len(words)))
    ends = lambda p: frozenset(w[len(p) :] for w in words if w.startswith(p))
    assert len(made.final) == len({ends(w[:k]) for w in words for k in range(len(w) + 1)})  # a state for each set of endings
    assert made.number(*flat(["abababab", "b" * 9])).tolist() == [-1, -1]
    head = [draw.randint(0, len(w)) for w in words]
    tail = [draw.randint(0, len(w) - h) for w, h in zip(words, head, strict=True)]
    q, number = made.near(data, off, np.array(head), np.array(tail))
    want = [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if differ_by_one(x, y, head[i], tail[i])]
    assert sorted(zip(q.tolist(), number.tolist(), strict=True)) == want


def test_op13_equals_brute_force(spark, texts):
    got = spelling.op13_spelling(spark, DATA)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(brute_words(texts.items()))


def crowd():
    """Many words with one beginning, many with one end, and chains of forms."""
    draw = random.Random(5)
    n = {}
    for _ in range(400):
        tail = "".join(draw.choice("abcä") for _ in range(draw.randint(3, 7)))
        n["samehead" + tail] = draw.choice([2, 3, 40, 500])
        n[tail + "sametail"] = draw.choice([2, 3, 40, 500])
    return n | {"chainab": 2, "chainabc": 20, "chainabcd": 200, "chainxbcd": 2000, "alonealone": 9, "a" * 900: 2, "a" * 901: 30, "a" * 450 + "b" + "a" * 449: 2}


@pytest.mark.parametrize("most", [8, 64, 1 << 17])
def test_crowded_halves_are_parted(spark, most):
    n = crowd()
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), most_words=most)
    assert sorted(map(tuple, got.collect())) == brute_variants(n)


def test_edge_cases(edges, nothing):
    got = sorted(map(tuple, spelling.spelling_variants(edges, damage=31).collect()))
    assert got == brute_variants(brute_words([(e[0], e[1]) for e in EDGES]))
    assert spelling.spelling_variants(nothing).count() == 0


def test_very_long_texts_and_words(spark):
    long = " ".join(f"longword{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(250_000))  # 2.7 MB
    rows = [(1, long), (2, "y" * 3_000 + " " + "y" * 3_000), (3, ("y" * 2_999 + " ") * 20), (4, None)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_variants(brute_words(rows, 0))

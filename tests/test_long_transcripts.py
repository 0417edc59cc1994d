import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.operators.long_transcripts import Cutter, long_passages
from lettermill.operators.transcripts import passages

WORDS = ["One", "two.", "three", "Four!", "x" * 30, "è.", "È", " ", "\n\n", "  ", " ", "5", "end?", "A", "b" * 90, ".", "No."]


def prose(draw, n):
    return "".join(draw.choice(WORDS) + draw.choice([" ", " ", "", "  "]) for _ in range(n))


def told(cutters_out):
    return [(t, a) for a, t in cutters_out]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(0, 400), max_size=6), st.booleans(), st.sampled_from([(60, 15), (1200, 200), (7, 3), (40, 100)]))
def test_stretches_of_any_length_give_the_passages_of_the_whole(seed, cuts, compat, sizes):
    draw = random.Random(seed)
    text = prose(draw, draw.randint(0, 120))
    size, overlap = sizes
    got, state, read, at = [], None, 0, 0
    edges = sorted({min(c, len(text)) for c in cuts} | {len(text)})
    for e in edges:
        cutter = Cutter(size, overlap, compat, state)
        cutter.feed(text[at:e])
        if e == edges[-1]:
            cutter.finish()
        got += [(t, a + read) for a, t in cutter.out]
        state, read, at = cutter.state(), read + (e - at), e
    want = [(p["text"], p["from_char"]) for p in passages(text, size, overlap, compat)]
    lead = len(text) - len(text.lstrip())
    assert [(t, a - lead) for t, a in got] == want


@pytest.mark.parametrize("block_chars", [300, 5000, 4 << 20])
def test_transcripts_in_parts(spark, block_chars):
    draw = random.Random(9)
    docs = {k: prose(draw, n) for k, n in ((1, 3000), (2, 10), (3, 0), (4, 400))}
    docs[5] = "  \n " + "y" * 9000 + " " * 700 + "Z. End."
    docs[None] = "Null too. " * 50
    rows = []
    for doc, text in docs.items():
        at, seq = 0, 0
        while at < len(text) or not seq:
            n = draw.randint(0, 60)
            rows.append((doc, seq, text[at : at + n] or None))
            at, seq = at + n, seq + 1
    draw.shuffle(rows)
    got = long_passages(spark.createDataFrame(rows, "doc int, seq int, text string").repartition(4), block_chars=block_chars).collect()
    for doc, text in docs.items():
        mine = [(r.ordinal, r.text, r.from_char, r.to_char) for r in sorted((r for r in got if r.doc == doc), key=lambda r: r.ordinal)]
        assert mine == [(p["ordinal"], p["text"], p["from_char"], p["to_char"]) for p in passages(text)], doc


def test_no_parts(spark):
    assert long_passages(spark.createDataFrame([], "doc int, seq int, text string")).count() == 0


def test_texts_are_written_once_and_passages_once_a_round(spark):
    from pathlib import Path

    from lettermill.session import scratch

    draw = random.Random(4)
    text = " ".join(f"{draw.getrandbits(200):x}." for _ in range(12000))
    rows = [(1, k, text[k * 1000 : k * 1000 + 1000]) for k in range(len(text) // 1000 + 1)]
    with scratch(spark) as folder:
        got = long_passages(spark.createDataFrame(rows, "doc int, seq int, text string"), block_chars=50_000).orderBy("ordinal").collect()
        written = sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))
    assert [(r.text, r.from_char) for r in got] == [(p["text"], p["from_char"]) for p in passages(text)]
    assert written < 4 * len(text)

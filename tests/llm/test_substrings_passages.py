import dataclasses
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import passages, relative, runindex, substrings, winnow
from lettermill.llm import textbytes as tb
from tests.llm.conftest import DATA, EDGES


def brute_substrings(rows, length=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(hashlib.blake2b(b[k : k + length], digest_size=12).digest() for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[k : k + length], digest_size=12).digest()] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_passages(rows, size=50):
    least = {}
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    rank = lambda i: -(2**63) if i is None else i
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(rank(i), least.get(key, rank(i)))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < rank(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(frame, columns):
    return sorted((tuple(r) for r in frame.select("doc_id", *columns).collect()), key=str)


BYTES = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("runs", [256, 2])
def test_documents(spark, texts, monkeypatch, runs):
    """Also with anchors split over several groups."""
    monkeypatch.setattr(winnow, "GROUP_RUNS", runs)
    assert got(substrings.op2_substrings(spark, DATA), BYTES) == brute_substrings(texts.items())
    assert got(passages.op3_passages(spark, DATA), WORDS) == brute_passages(texts.items())


@pytest.mark.parametrize("runs", [256, 1])
def test_edge_cases(edges, monkeypatch, runs):
    monkeypatch.setattr(winnow, "GROUP_RUNS", runs)
    rows = [(r[0], r[1]) for r in EDGES]
    out = substrings.remove_repeated_substrings(edges)
    assert got(out, BYTES) == brute_substrings(rows) and set(edges.columns) <= set(out.columns)
    out = passages.remove_repeated_passages(edges)
    assert got(out, WORDS) == brute_passages(rows) and set(edges.columns) <= set(out.columns)


def test_nothing(nothing):
    assert substrings.remove_repeated_substrings(nothing).count() == 0
    assert passages.remove_repeated_passages(nothing).count() == 0


def test_a_passage_in_very_many_texts(spark):
    shared = " ".join(f"s{k}" for k in range(120))
    rows = [(k, f"{' '.join(f'x{k}y{j}' for j in range(40))} {shared} {' '.join(f'z{k % 7}y{j}' for j in range(60))}") for k in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(passages.remove_repeated_passages(frame), WORDS) == brute_passages(rows)
    assert got(substrings.remove_repeated_substrings(frame), BYTES) == brute_substrings(rows)


def test_a_passage_twice_in_each_of_very_many_texts(spark):
    """Both places go, also where the smaller id is in another group of the anchor."""
    hot = " ".join(f"hot{k}" for k in range(60))
    rows = [(k, " ".join([*(f"a{k}x{j}" for j in range(60)), hot, *(f"b{k}x{j}" for j in range(60)), hot,
        *(f"c{k}x{j}" for j in range(60))])) for k in range(700)]
    out = passages.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, WORDS) == brute_passages(rows)


TEXTS = st.lists(st.binary(max_size=60).map(lambda b: bytes((0, 7, 255)[x % 3] for x in b)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(2, 8))
def test_streaming_through_the_run_length_index_finds_every_long_match(segments, length):
    """Zero bytes, equal segments and overlaps included."""
    edge, data = np.cumsum([0, *map(len, segments)]), np.frombuffer(b"".join(segments), np.uint8)
    count = Counter(s[k : k + length] for s in segments for k in range(len(s) - length + 1))
    want = [k + length <= len(s) and count[s[k : k + length]] > 1 for s in segments for k in range(len(s))]
    assert not len(data) or runindex.RunLengthIndex(data, edge, length).stream(length).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_suffix_arrays(text):
    x, _ = runindex.joined(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    want = sorted(range(len(x)), key=lambda k: x[k:].tolist())
    assert runindex.suffix_array(runindex.packed(x)).tolist() == want and relative.suffix_ranks(x)[0].tolist() == want


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(2, 8), st.randoms())
def test_factors_are_the_longest_and_find_every_earlier_window(segments, length, random):
    edge, data = np.cumsum([0, *map(len, segments)]), np.frombuffer(b"".join(segments), np.uint8)
    owner = np.array([random.randint(0, 3) for _ in segments])
    earlier = lambda k, s: any(s in t for t, o in zip(segments, owner) if o < owner[k])
    want = [i + length <= len(s) and earlier(k, s[i : i + length]) for k, s in enumerate(segments) for i in range(len(s))]
    assert relative.repeated_starts(data.astype(np.uint64), edge, owner, length).tolist() == want
    ref = relative.Reference(data.astype(np.uint64), edge, owner)
    for k, at, size in zip(*(x.tolist() for x in ref.factors())):
        s, a = segments[k], at - int(ref.begin[k])
        assert (not size or earlier(k, s[a : a + size])) and not (a + size < len(s) and earlier(k, s[a : a + size + 1]))


@pytest.mark.parametrize("kind", [passages.WORDS, substrings.BYTES])
def test_pieces_of_a_long_text_hold_each_window_once(kind):
    raw = " ".join(f"n{k}" for k in np.random.default_rng(4).integers(0, 10**6, 900)).encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    ((sym, _, _),) = kind.pieces(data, off, 50)
    small = dataclasses.replace(kind, piece=128)
    parts = [(base, winnow.grams(s, 50)) for s, _, base in small.pieces(data, off, 50)]
    assert len(parts) > 5 and np.concatenate([g for _, g in parts]).tolist() == winnow.grams(sym, 50).tolist()
    assert [base for base, _ in parts] == np.cumsum([0, *(len(g) for _, g in parts)])[:-1].tolist()


@pytest.mark.parametrize(("kind", "length", "gram"), [(passages.WORDS, passages.WINDOW, passages.GRAM), (substrings.BYTES, substrings.LENGTH, substrings.GRAM)])
def test_blocks_of_real_anchors_are_even(texts, kind, length, gram):
    """Anchors are minima, so their leading bits are not; blocks go by mixed ones."""
    raw = [(t or "").encode() for t in texts.values()]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, edge = kind.edges(data, off)
    anchors = np.unique(winnow.runs_of(kind.codes(data, starts, ends), edge, length, gram).anchor)
    size = np.bincount((tb.mix64(anchors) % np.uint64(16)).astype(int), minlength=16)
    assert len(anchors) > 1000 and size.max() < 1.4 * size.mean() and size.min() > 0.6 * size.mean()


def test_a_text_of_several_megabytes(spark):
    rng = np.random.default_rng(6)
    w = [f"v{k}" for k in rng.integers(0, 10**9, 250_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[200_000:200_100])), (3, " ".join(w[1000:1049]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows[0][1]) > 2 << 20
    assert got(passages.remove_repeated_passages(frame), WORDS) == brute_passages(rows)
    assert got(substrings.remove_repeated_substrings(frame), BYTES) == brute_substrings(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=200), st.integers(1, 9), st.integers(0, 20))
def test_every_window_is_in_one_run_and_equal_windows_have_equal_anchors(symbols, gram, more):
    length = min(gram + more, 10)
    gram = min(gram, length)
    x = np.array(symbols, np.uint64)
    off = np.array([0, len(x) // 3, len(x)])
    runs = winnow.runs_of(x, off, length, gram)
    anchors = {}
    n = 0
    for t, a, c, h in zip(runs.text, runs.first, runs.count, runs.anchor):
        for k in range(a, a + c):
            n += 1
            window = tuple(x[off[t] + k : off[t] + k + length].tolist())
            assert anchors.setdefault(window, h) == h
    assert n == sum(max(0, int(b - a) - length + 1) for a, b in zip(off, off[1:]))

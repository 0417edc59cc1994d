import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import embedding_join, simhash
from lettermill.llm import textbytes as tb
from tests.llm.conftest import DATA, EDGES


def fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def least_reachable(ids, linked):
    end = list(range(len(ids)))

    def find(k):
        while end[k] != k:
            k = end[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        end[max(a, b)] = min(a, b)
    out = {}
    for k, i in enumerate(ids):
        if i is not None:
            out[find(k)] = min(i, out.get(find(k), i))
    return [out.get(find(k)) for k in range(len(ids))]


def brute_simhash(rows):
    prints = [fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least_reachable([i for i, _ in rows], links))), key=str)


def test_documents(spark, texts):
    rows = simhash.op5_simhash(spark, DATA).collect()
    assert sorted(map(tuple, rows), key=str) == brute_simhash(list(texts.items()))


def test_edge_cases(edges, nothing):
    rows = [(r[0], r[1]) for r in EDGES]
    out = simhash.simhash_groups(edges)
    assert sorted((tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()), key=str) == brute_simhash(rows)
    assert simhash.simhash_groups(nothing).count() == 0
    kept = simhash.simhash_dedup(edges)
    want = {c for _, _, c in brute_simhash(rows)}
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert simhash.simhash_dedup(nothing).count() == 0


def test_ring_finds_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for n in (1, 2, 3, 3, 3, 4, 4):
            values.add(b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    values = sorted(values)
    links = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    want = least_reachable(values, links)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    for group_rows in (512, 2):
        frame = spark.createDataFrame([(v,) for v in signed], "fp long")
        pairs = [(r.a, r.b) for r in simhash.ring_links(frame, group_rows).collect()]
        place = {v: k for k, v in enumerate(signed)}
        assert least_reachable(values, [(place[a], place[b]) for a, b in pairs]) == want


def brute_near_copies(rows):
    """Ids that stay: all pairs of sketches compared, without any filter."""
    raw = [(t or "").encode() for _, t in rows]
    prints, slots = simhash.sketch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    links = []
    for a in range(len(rows)):
        for b in range(a):
            filled = (slots[a] != simhash.EMPTY) | (slots[b] != simhash.EMPTY)
            if int(prints[a] ^ prints[b]).bit_count() <= 6 and ((slots[a] == slots[b]) & filled).sum() >= simhash.SIMILARITY * filled.sum():
                links.append((a, b))
    place = least_reachable(list(range(len(rows))), links)
    groups = {}
    for k, g in enumerate(place):
        groups.setdefault(g, []).append(rows[k][0])
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def test_near_copies_of_documents(documents, texts, monkeypatch):
    for group_rows in (512, 3):
        monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
        kept = sorted((r.doc_id for r in simhash.near_copy_dedup(documents).collect()), key=str)
        assert kept == brute_near_copies(list(texts.items()))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    similarity = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert not [(a, b) for a in kept for b in kept if a < b and similarity(a, b) >= 0.9]
    assert all(max(similarity(a, b) for b in texts if a != b) >= 0.7 for a in set(texts) - set(kept))


def test_near_copies_of_edited_texts(spark):
    rng = np.random.default_rng(3)
    original = [f"w{k}" for k in rng.integers(0, 4000, 600)]
    rows = [(0, " ".join(original))]
    for k in range(1, 40):
        w = list(original)
        for at in rng.choice(600, 6, replace=False):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"w{j}" for j in rng.integers(0, 4000, 300))) for k in range(40)]
    kept = sorted(r.doc_id for r in simhash.near_copy_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [0, *range(100, 140)]


def test_near_copies_with_added_cut_and_replaced_blocks(spark):
    """Against the true similarity of the five-word shingles, of long and short texts."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"n{k}" for k in rng.integers(0, 10**9, n)]
    rows = []
    for n in (400, 400, 400, 120, 16) * 8:
        w = fresh(n)
        part = n // 10
        kinds = [w, w + fresh(part), fresh(part) + w, w[:-part], w[: n // 2] + fresh(part // 2) + w[n // 2 + part // 2 :]]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(kinds)]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    similarity = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    links = [(a, b) for a in range(len(rows)) for b in range(a - a % 5, a) if similarity(a, b) >= 0.8]
    want = sorted(set(least_reachable(list(range(len(rows))), links)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_copy_dedup(frame).collect()) == want


def test_a_long_list_of_near_copies_and_strays(spark, monkeypatch):
    """Lists cut into many chunks; strays that hang together with few of a list are found."""
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(150):  # a large group: one word changed in each
        w = list(base)
        w[int(rng.integers(300))] = f"e{k}"
        rows.append((k, " ".join(w)))
    drift = list(base)
    for k in range(150, 170):  # a chain that leaves the group step by step
        for at in rng.choice(300, 4, replace=False):
            drift[at] = f"d{k}x{at}"
        rows.append((k, " ".join(drift)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_near_copies(rows)
    for group_rows in (512, 16, 5):
        monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
        assert sorted(r.doc_id for r in simhash.near_copy_dedup(frame).collect()) == want


def test_near_copies_of_edge_cases(edges, nothing):
    kept = simhash.near_copy_dedup(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute_near_copies([(r[0], r[1]) for r in EDGES])
    assert simhash.near_copy_dedup(nothing).count() == 0


VECTORS = [
    (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.3]), (4, [1.0, 0.6]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [1.0, None]), (9, [float("nan"),
        1.0]), (10, [float("inf"), 1.0]),
    (11, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [-1.0, 0.0]), (14, [1e200, 0.0]), (None, [0.0, 1.0]), (None, [5.0, 5.0, 5.0, 5.0]), (7, [0.0, 3.0]),
        (15, [5.0, 5.0, 5.0, 5.0]), (15, [5.0, 5.0, 5.0, 5.0]),
]


def brute_vectors(rows, threshold=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.sqrt((v * v).sum())

    u = [unit(v) for _, v in rows]
    links = [(a,
        b) for a in range(len(rows)) for b in range(a) if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= threshold]
    n = [sum(k in p for p in links) for k in range(len(rows))]
    ends = least_reachable([i for i, _ in rows], links)
    return sorted(((i, k, e, (i == e and i is not None) or x is None) for (i, _), k, e, x in zip(rows, n, ends, u)), key=str)


def test_vectors(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in VECTORS], "vec_id long, embedding array<double>, n_links string, cid int")
    out = embedding_join.embedding_groups(frame)
    assert sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == brute_vectors(VECTORS)
    assert "cid" in out.columns and embedding_join.embedding_groups(frame.where("1 = 0")).count() == 0


@pytest.mark.parametrize("width", [8, 64, 3000, 20_000])
def test_the_screen_loses_no_pair_just_above_the_limit(width):
    rng = np.random.default_rng(width)
    a = embedding_join.unit(np.abs(rng.normal(size=(40, width))) + 1)  # sums of one sign err the most
    side = rng.normal(size=a.shape)
    side = embedding_join.unit(side - (side * a).sum(1, keepdims=True) * a)
    cosine = 0.95 + rng.uniform(-1, 1, (40, 1)) * 10.0 ** rng.uniform(-9, -5, (40, 1))
    b = embedding_join.unit(cosine * a + np.sqrt(1 - cosine**2) * side)
    want = {(i, j) for i, j in zip(*np.nonzero(a @ b.T >= 0.95), strict=True)}
    same = np.full(40, width)
    got = {(i, j) for x, y in embedding_join.compare(a, b, same, same, 0.95) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    edge = {(i, j) for i, j in want ^ got if abs(a[i] @ b[j] - 0.95) > 1e-12}
    assert not edge and (width < 3000 or embedding_join.screen(width) > embedding_join.SLACK)


def test_many_cells_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    rows = [(k, (centres[k % 30] + rng.normal(size=8) * 0.12).tolist()) for k in range(600)]
    want = brute_vectors(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for chunk in (4096, 7):
        monkeypatch.setattr(embedding_join, "CHUNK", chunk)
        out = embedding_join.embedding_groups(frame)
        assert sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=12), st.integers(0, 2**64 - 1))
def test_xxh64(parts, seed):
    edge = np.cumsum([0, *map(len, parts)])
    got = simhash.xxh64(np.frombuffer(b"".join(parts), np.uint8), edge[:-1], edge[1:], seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB \n\tü1."), max_size=20), max_size=6))
def test_words_of_a_batch(parts):
    raw = [p.encode() for p in parts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, first = tb.word_spans(data, off)
    got = [[data[a:b].tobytes() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first, first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", r) for r in raw]
    hashes = tb.word_hashes(data, starts, ends)
    words = [w for ws in got for w in ws]
    assert len(set(hashes.tolist())) == len(set(words)) and len(hashes) == len(words)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10])
def test_window_min(width):
    x = np.random.default_rng(width).integers(0, 100, 50).astype(np.uint64)
    assert tb.window_min(x, width).tolist() == [x[k : k + width].min() for k in range(50 - width + 1)]

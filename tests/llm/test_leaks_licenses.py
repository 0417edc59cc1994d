import math
import random
import re
from collections import Counter

import pytest

from lettermill.llm import decontaminate, licenses
from tests.llm.conftest import DATA, EDGES, words


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_leaks_of_documents(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, DATA).collect()}
    flat = lambda t: " ".join(t.lower().split())
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if flat(x) in flat(t)}
    assert whole <= got and all(decontaminate.THRESHOLD <= r.score for r in decontaminate.op6_decontaminate(spark, DATA).collect())
    for d, i in got - whole:  # near copies at most: most of the item's words in order
        w = flat(items[i]).split()
        assert sum(" ".join(w[k : k + 3]) in flat(texts[d]) for k in range(len(w) - 2)) >= 0.5 * (len(w) - 2)


def brute_leaks(texts, items, threshold=decontaminate.THRESHOLD):
    """Every item against every passage of every text, from the words."""
    split = lambda t: [w.translate(LOWER) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    shingled = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    known = [(i, split(t), t) for i, t in items if t is not None]
    df = Counter(w for _, ws, _ in known for w in set(ws))
    mean = max(sum(len(ws) for _, ws, _ in known) / max(len(known), 1), 1.0)
    idf = lambda w: math.log1p((len(known) - df[w] + 0.5) / (df[w] + 0.5))
    out = []
    for text in map(split, texts):
        got = []
        for i, ws, raw in known:
            if not ws:
                continue
            impact = {w: idf(w) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in Counter(ws).items()}
            cell = next(4**k * 16 for k in range(20) if 4**k * 16 >= len(ws))
            parts = re.split(r"(?<=[.!?])\s+", raw.strip())
            nq, size = len(split(" ".join(parts[:-1]))) if len(parts) > 1 else 0, min(3, len(ws))
            question = shingled(ws[: max(nq, size)] if len(parts) > 1 else ws, size)
            answer = shingled(ws[max(0, nq - size + 1) :], size) if 0 < nq < len(ws) else shingled(ws, size)
            best = None
            for a in range(0, len(text), cell):
                passage = text[a : a + 2 * cell]
                have, seen = set(passage), shingled(passage, size)
                score = sum(x for w, x in impact.items() if w in have) / sum(impact.values())
                q, ans = (len(s & seen) / len(s) for s in (question, answer))
                if score >= threshold - 1e-9 and q >= 0.6 and ans >= 0.6 and (best is None or score > best[0] + 1e-12):
                    best = (score, q, ans, a)
            if best:
                got.append((i, *best))
        out.append(sorted(got, key=lambda x: (x[0] is None, x[0])))
    return out


def leaks_of(rows):
    return [[(x.item_id, x.score, x.question_overlap, x.answer_overlap, x.first_term) for x in r.leaks] for r in rows]


def close(got, want):
    assert [[x[0] for x in g] for g in got] == [[x[0] for x in w] for w in want]
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert abs(x[1] - y[1]) < 1e-9 and x[2:4] == y[2:4] and (x[4] == y[4] or abs(x[1] - y[1]) < 1e-9)


def test_leaks_against_brute_force(spark, texts, monkeypatch):
    """Whole and edited items in texts, items of all lengths, whatever the size of an index block."""
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(900, "Who wrote Hamlet? William Shakespeare."), (901, "zyzzyva"), (902, "two words"), (903, "one two three"), (904,
        " ".join(f"l{k}" for k in range(300)) + ". The end."), (905, "..."), (None, "No number? None."), (906, None)]
    rows = list(texts.values())[:30] + [None, "", "the zyzzyva", "in two words or one two three four",
        "Ask who wrote Hamlet: William Shakespeare did", "NO NUMBER, NONE"]
    for _, t in items:
        w = (t or "").split()
        if w:
            rows += [" ".join([*rows[0].split()[:40], *w, *rows[1].split()[:40]]), " ".join(x for x in w if rng.random() > 0.1), " ".join(w[len(w) // 2 :])]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    assert sum(map(bool, want)) > len(items)
    for size in (8 << 20, 2000, 300):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        close(leaks_of(sorted(decontaminate.find_leaks(frame, table).collect(), key=lambda r: r.doc_id)), want)


def test_wand_retrieves_all_above_any_threshold():
    import numpy as np

    rng = random.Random(7)
    words_ = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(k, " ".join(rng.sample(words_, rng.randint(1, 14)))) for k in range(200)]
    df = Counter(x for _, t in rows for x in set(decontaminate._terms_of(t).view("int64").tolist()))
    index = decontaminate.build_index(rows, len(rows), 7.0, df)
    (lists,) = index.lists
    for _ in range(60):
        have = np.unique(np.array(rng.sample(range(len(index.vocabulary)), 40)))
        scores = {}
        for t, i, x in zip(lists.term.tolist(), lists.item.tolist(), lists.impact.tolist()):
            if t in set(have.tolist()):
                scores[i] = scores.get(i, 0.0) + x
        for threshold in (0.2, 0.5, 0.9):
            want = {i: s for i, s in scores.items() if s >= threshold - 1e-9}
            got = dict(lists.above(have, threshold))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("size", [8 << 20, 500])
def test_leaks_at_any_threshold(spark, monkeypatch, size):
    """Items of common terms alone, too: what they score must not be lost at a low threshold."""
    rng = random.Random(11)
    pool = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, f"{text(rng.randint(3, 12))}. {text(rng.randint(2, 5))}.") for k in range(60)] + [(100 + k, f"w1 w2 w{k}") for k in range(12)]
    texts = [f"{text(40)} {rng.choice(items)[1]} {text(40)}" for _ in range(40)] + ["w1 w2 w3 w1 w2", "", text(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    for threshold in (0.1, 0.2, 0.4, 0.5, 0.7, 0.9):
        got = leaks_of(sorted(decontaminate.find_leaks(frame, table, threshold=threshold).collect(), key=lambda r: r.doc_id))
        close(got, brute_leaks(texts, items, threshold))


def test_leaks_of_edge_cases(spark, edges, nothing, monkeypatch):
    items = [(1, words(30, 5)), (2, None), (3, ""), (4, "word1"), (None, words(20, 510)), (1, words(30, 5)), (9, "What is it? " + words(12,
        900) + ". Answer nine.")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(len, brute_leaks([r[1] for r in EDGES], items)))
    assert want[-1] == 4
    for size in (decontaminate.INDEX_BYTES, 200):  # the latter: several blocks
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        out = decontaminate.find_leaks(edges, table)
        assert sorted(len(r.leaks) for r in out.collect()) == want and set(out.columns) == set(edges.columns)
    assert decontaminate.find_leaks(nothing, table).count() == 0
    assert {len(r.leaks) for r in decontaminate.find_leaks(edges, table.where("1 = 0")).collect()} == {0}


def test_licences_of_documents(spark, texts):
    rows = {r.doc_id: r for r in licenses.op8_licenses(spark, DATA).collect()}
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        assert rows[i].own_license in ([k for k, v in lines.items() if v in t] or [None])


def test_nearest_directory_speaks(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "Nothing of the kind is said here, and nobody would think so. " * 5
    rows = [("LICENSE", mit), ("a/b/COPYING", gpl), ("a/b/c/x.py", prose), ("a/y.py", prose), ("a/b/c/z.py", f"{prose}\n{mit}"), ("top.py", None),
        (None, prose), ("a/b/c/", ""), ("q/licensed.txt", f"{prose} {gpl}")]
    frame = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.inherit(licenses.scan(frame)).collect()}
    assert got == {0: ("MIT", None), 1: ("GPL-3.0", None), 2: ("GPL-3.0", "a/b"), 3: ("MIT", ""), 4: ("MIT", None), 5: ("MIT", ""), 6: (None, None),
        7: ("GPL-3.0", "a/b"), 8: ("GPL-3.0", None)}


def test_headers_wrapped_over_lines(spark):
    """Sentences over several lines, with comment marks and other lines around them."""
    header = "{n} - a part of it\nCopyright (C) 2020 Somebody Else\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {k}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    kinds = [("GPL-3.0", ""), ("LGPL-3.0", "Lesser "), ("AGPL-3.0", "Affero ")]
    rows, want = [], {}
    for mark in ("", "# ", " * ", "// "):
        for name, kind in kinds:
            want[len(rows)] = name
            text = header.format(n="file.c", k=kind)
            rows.append((len(rows), "\n".join(mark + line for line in text.split("\n")) + "\nint main() { return run(1); }\n" * 9))
    mit = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files"
    rows += [(100, mit), (101, "All rights reserved. Unauthorized copying\nof this file is strictly prohibited."), (102,
        "The program is free to\nuse the terms of the text,\nor any later version of it.")]
    want |= {100: "MIT", 101: "Proprietary", 102: None}
    rows += [(1000 + k, f"{words(50)} the program is of any use to you and it or the files in this work {k}") for k in range(50)]
    got = {r.doc_id: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and not any(v for k, v in got.items() if k >= 1000)


def brute_units(text):
    """Lines and sentences in them, sentences over lines, paragraphs, the text."""
    term = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    found = [(m.start(), m.end(), m.group().translate(LOWER)) for m in term.finditer(text)]
    out = [[], [], [], []]
    for k, (a, _, w) in enumerate(found):
        gap = text[found[k - 1][1] : a] if k else b""
        end = bool(re.search(rb"[.!?](?=[ \t\n\r\x0b\x0c])", gap)) and not re.match(rb"[a-z0-9]", text[a:])
        lines = gap.count(b"\n")
        for cut, groups in zip((lines > 0 or end, lines > 1 or end or (lines > 0 and b":" in gap), lines > 1, False), out):
            if not k or cut:
                groups.append([])
            groups[-1].append(w)
    return [g for groups in out for g in groups], out[3]


def brute_licences(texts, templates, threshold):
    raw = [(t or "").encode() for t in texts]
    split = lambda b: [w.translate(LOWER) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)]
    df = Counter(w for b in raw for w in set(split(b)))
    idf = lambda w: math.log((1 + len(raw)) / (1 + df[w])) + 1
    vector = lambda words: {w: n * idf(w) for w, n in Counter(words).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, vector(split(t.encode()))) for n, t in templates]
    out = []
    for b in raw:
        units, whole = brute_units(b)
        scored = []
        for u in units:
            v = vector(u)
            scored += [(sum(x * t.get(w, 0) for w, x in v.items()) / (size(v) * size(t)), -k, u in whole) for k, (_, t) in enumerate(known)]
        scored = [s for s in scored if s[0] >= threshold]
        best = max(scored, default=None)
        out.append((known[-best[1]][0] if best else None, best[0] if best else 0.0, any(s[2] for s in scored)))
    return out


def test_cosines_against_brute_force(spark, texts):
    notices = [t for _, t in licenses.TEMPLATES]
    rng = random.Random(2)
    rows = [t for t in list(texts.values())[:40]]
    for t in notices:
        w = t.split(" ")
        rows += ["\n".join([*rng.sample(rows[:40], 1), t]), " ".join(rng.choice(["word", x, x, x]) for x in w),
            "# " + "\n# ".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6)), t.upper() + " Indeed so."]
    rows += [None, "", "\n \n", "...", notices[0], notices[0]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for threshold in (0.5, 0.7):
        got = {r.doc_id: (r.own_license, r.own_score, r.whole_text) for r in licenses.scan(frame, threshold=threshold).collect()}
        want = brute_licences(rows, licenses.TEMPLATES, threshold)
        for k, (name, score, whole) in enumerate(want):
            assert abs(got[k][1] - score) < 1e-9 and got[k][2] == whole, (k, rows[k], got[k], want[k])
            tied = [n for n, t in licenses.TEMPLATES if name and abs(max(brute_licences_one(rows, k, [(n, t)],
                threshold)) - score) < 1e-9] if got[k][0] != name else [name]
            assert got[k][0] in tied


def brute_licences_one(rows, k, templates, threshold):
    return [brute_licences(rows, templates, threshold)[k][1]]


def test_inheritance_against_brute_force(spark):
    """A tree in which most files inherit."""
    rng = random.Random(3)
    texts_ = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY 4.0."]
    rows = []
    for k in range(400):
        parts = [rng.choice("abc") for _ in range(rng.randint(0, 4))]
        licence = rng.random() < 0.08
        name = rng.choice(["LICENSE", "COPYING", "license.txt"]) if licence else f"f{k}.py"
        rows.append((k, "/".join([*parts, name]), rng.choice(texts_) if licence else f"code of file {k} and nothing else"))
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.inherit(licenses.scan(frame)).collect()}
    own = {k: brute[0] for (k, _, _), brute in zip(rows, brute_licences([t for _, _, t in rows], licenses.TEMPLATES, licenses.THRESHOLD))}
    score = {k: brute[1] for (k, _, _), brute in zip(rows, brute_licences([t for _, _, t in rows], licenses.TEMPLATES, licenses.THRESHOLD))}
    speaks = {}
    for k, path, _ in rows:
        head, _, name = path.rpartition("/")
        if own[k] and re.match(licenses.LICENCE_FILE, name):
            speaks.setdefault(head, []).append((-round(score[k], 9), path, k, own[k]))
    n_inherit = 0
    for k, path, _ in rows:
        head = path.rpartition("/")[0]
        want = (own[k], None)
        while own[k] is None:
            if head in speaks:
                want = (min(speaks[head])[3], head)
                n_inherit += 1
                break
            if not head:
                break
            head = head.rpartition("/")[0]
        assert got[k] == want
    assert n_inherit > 200


def test_full_texts_and_titles(spark):
    rng = random.Random(1)
    prose = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(60)) for _ in range(60)]
    full = {n: t for n, t in licenses.TEMPLATES if "\n\n" in t}
    rows = [(k, "src/LICENSE", f"Copyright (c) 2020 Somebody Else\n\n{t}") for k, t in enumerate(full.values())]
    rows += [(50, "a/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "\n\n".join(prose[:30]))]
    rows += [(100 + k, "a/x", t) for k, t in enumerate(prose)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(full):
        assert (got[k].own_license, got[k].whole_text) == (name, True)
    assert (got[50].own_license, got[50].whole_text) == ("GPL-3.0", False) and not any(got[100 + k].own_license for k in range(60))


def test_licences_of_edge_cases(edges, nothing):
    from pyspark.sql import functions as F

    out = licenses.inherit(licenses.scan(edges.withColumn("path", F.concat("source", F.lit("/x")))))
    assert out.count() == len(EDGES) and set(edges.columns) <= set(out.columns) and out.where("license is not null").count() == 0
    assert licenses.inherit(licenses.scan(nothing.withColumn("path", F.lit("a/b")))).count() == 0

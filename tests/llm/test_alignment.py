import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from lettermill.llm import alignment
from lettermill.llm.alignment import FACTS, Vocabularies
from tests.llm.conftest import DATA, EDGES

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="the tokenizers are not here")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

ODD = [
    " ", "  ", "a", " a", "a ", "  a  b   c    ", "\n", "a\n b\n\n c\t d", "it's we'll they'VE don't I'm", "x <|endoftext|> y<|endoftext|>", "</s><s> <unk>",
    "<0x41> <0x0A>", "a▁b ▁c", "▁", "naïve café ½ ² 12 345 6", "日本語 テキスト　全角 スペース", "a b  c  d  e", "😀 👩‍👩‍👧 é",
    "العربية עברית ไทย", "a\u0085b \u0085 c", "tab\t\tand  \n \n mix", "x" * 3000, "!!! ### $$$%%% && *** ||", "a\x1cb \x1c c", "﻿bom", "ǅ ɐ ɐx ɏx",
    "Ünïcödé ßtraße ÑANDÚ", "1,234.50 €", "a\0b \0 c",
]


@pytest.fixture(scope="module")
def whole():
    a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTES_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES_FILE}")


def brute_alignment(rows, whole):
    """From the tokens of whole texts, by comparing all neighbours byte by byte."""
    a, b = whole
    letter = alignment.byte_of_letter()
    docs, pairs = [], Counter()
    for ident, text in rows:
        links, groups, ta, tb = [], "", [], []
        if text:
            raw = (" " + text).encode()
            ta = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
                ta, tb = [], []
        owner, at, ends = {}, 0, [set(), set()]
        for k, (_, x) in enumerate(tb):
            owner.update(dict.fromkeys(range(at, at + len(x)), k))
            at += len(x)
            ends[1].add(at)
        at = 0
        for i, x in ta:
            links += [(i, tb[k][0]) for k in sorted({owner[p] for p in range(at, at + len(x))})]
            at += len(x)
            ends[0].add(at)
        cuts, told = sorted(ends[0] & ends[1]), []
        parts = [defaultdict(list), defaultdict(list)]
        for side, tokens in enumerate((ta, tb)):
            at = 0
            for i, x in tokens:
                at += len(x)
                parts[side][next(c for c in cuts if c >= at) if len(cuts) < 50 else cuts[__import__("bisect").bisect_left(cuts, at)]].append(str(i))
        for c in cuts:
            told.append(",".join(parts[0][c]) + "|" + ",".join(parts[1][c]))
        groups = ";".join(told)
        docs.append((ident, len(ta), len(tb), len(cuts), links, groups))
        pairs.update(links)
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, ng, len(ls), sum(pairs[p] == most[p[1]] for p in ls), sum(pairs[p] for p in ls), g) for i, na, nb, ng, ls, g in docs]


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("doc_id", *FACTS, "groups")) for r in frame.collect()), key=str)


def test_segments_have_the_tokens_of_whole_texts(whole):
    align = alignment.Aligner(Vocabularies.read())
    assert align.quick is not None
    for text in [t for t in ODD if "▁" not in t]:
        raw = text.encode()
        data, starts, _ = alignment.cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        segments = [data.tobytes()[x:y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        assert b"".join(segments).decode() == " " + text
        for clean in ([False] * len(segments), [len(s) > 1 and not alignment.NO_CUT[s[1]] and s[-1] != 32 for s in segments]):
            assert align.tokens_of_a(segments, np.array(clean))[0].tolist() == whole[0].encode(" " + text, add_special_tokens=False).ids, text
            ids, n, ok = align.tokens_of_b(segments, np.array(clean))
            assert ids.tolist() == whole[1].encode(text) and n.sum() == len(ids) and ok.all(), text


def test_places_are_forgotten(whole, monkeypatch):
    """A worker that keeps few segments finds the same."""
    monkeypatch.setattr(alignment, "KEPT_SEGMENTS", 5)
    align = alignment.Aligner(Vocabularies.read())
    segments = [f" w{k % 13}a▁b"[: 3 + k % 5].encode() for k in range(60)]
    for k in range(0, 60, 4):
        part = sorted(set(segments[k : k + 4]))
        at = align(part)
        new = alignment.Aligner(Vocabularies.read())
        there = new(part)
        assert (align.facts[at] == new.facts[there]).all() and (align.ok[at] == new.ok[there]).all()
        assert [align.written[i] for i in at] == [new.written[i] for i in there] and (align.links_at(at)[0] == new.links_at(there)[0]).all()


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50, 2])
def test_equals_brute_force(spark, texts, whole, frequent):
    rows = [*sorted(texts.items())[:60], *((1000 + k, t) for k, t in enumerate(ODD)), (None, None), (7, ""), (8, "same text"), (8, "same text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(frame, Vocabularies.read(), frequent=frequent)) == sorted(brute_alignment(rows, whole), key=str)


def test_op11_over_its_whole_table(spark, texts, whole):
    got = alignment.op11_alignment(spark, DATA)
    assert got.columns == ["doc_id", *FACTS, "groups_sha256"]
    want = {(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_alignment(texts.items(), whole)}
    assert {tuple(r) for r in got.collect()} == want


def test_edge_cases(edges, nothing, whole):
    out = alignment.align(edges, Vocabularies.read(), digest=True)
    assert set(out.columns) == {*edges.columns, *FACTS, "groups"} and out.count() == len(EDGES)
    few = [(e[0], e[1]) for e in EDGES]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_alignment(few, whole)]
    assert rows_of(out) == sorted(want, key=str)
    assert alignment.align(nothing, Vocabularies.read()).count() == 0


def test_a_very_long_text(spark, texts, whole):
    rows = [(1, "\n".join(t for t in texts.values() if t) * 5 + "x" * 200_000), (2, "short")]
    assert len(rows[0][1]) > 2_000_000
    got = rows_of(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), Vocabularies.read()))
    assert got == sorted(brute_alignment(rows, whole), key=str)

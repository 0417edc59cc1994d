import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.operators.transcripts import MIN_PASSAGE, passages, sentence_pieces, with_passages

prose = lambda n: " ".join(f"Sentence number {k} says something about the load." for k in range(n))


def test_nothing_in_nothing_out():
    assert passages(None) == passages("") == passages(" \n  ") == []


def test_short_text_is_one_passage():
    assert passages("  One. Two.  ") == [{"ordinal": 0, "text": "One. Two.", "from_char": 0, "to_char": 9}]


def test_passages_end_with_sentences_and_overlap():
    got = passages(prose(100))
    assert all(p["text"].endswith(".") for p in got) and [p["ordinal"] for p in got] == list(range(len(got)))
    assert all(b["from_char"] < a["to_char"] for a, b in zip(got, got[1:]))
    assert all(p["text"] == prose(100)[p["from_char"] : p["to_char"]] for p in got)


def test_every_sentence_is_somewhere():
    text = prose(300)
    assert all(any(s in p["text"] for p in passages(text)) for s in re.split(r"(?<=\.) ", text))


def test_text_without_sentences_is_cut_hard():
    assert all(len(p["text"]) <= 1200 for p in passages("word " * 2000))
    assert [len(p["text"]) for p in passages("x" * 5000)] == [1200, 1200, 1200, 1200, 200]


def test_short_tail_goes_to_the_passage_before():
    got = passages(prose(100) + " Right.")
    assert got[-1]["text"].endswith("Right.") and all(len(p["text"]) >= MIN_PASSAGE for p in got)


def test_sizes():
    assert len(passages(prose(100), size=400)) > len(passages(prose(100), size=1600))


def test_carried_tail_appears_twice_unless_told_otherwise():
    text = "A" * 1149 + ". " + "B" * 59 + "."
    twice, once = passages(text), passages(text, compat=False)
    assert len(twice) == len(once) == 1 and twice[0]["text"].count("B" * 59) == 2 and once[0]["text"] == text


def test_short_sentence_then_an_unpunctuated_run():
    got = passages("Yes. " + "X" * 4800)
    assert [len(p["text"]) for p in got][1:3] == [2401, 2401]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?AÈ1\n ", max_size=80), max_size=30), st.integers(20, 90), st.integers(0, 30))
def test_pieces_cover_the_text(parts, size, overlap):
    text = " ".join(parts).strip()
    pieces = sentence_pieces(text, size) if text else []
    assert all(a < b <= a + size for a, b in pieces)
    rest = "".join(text[b:a] for (_, b), (a, _) in zip(pieces, pieces[1:]))
    assert not rest.strip() and (not text or (pieces[0][0] == 0 and pieces[-1][1] == len(text)))
    got = passages(text, size, overlap)
    assert [p["from_char"] for p in got] == sorted(p["from_char"] for p in got) and all(len(p["text"]) <= 2 * size + overlap + MIN_PASSAGE + 2 for p in got)


def test_frame(spark):
    frame = spark.createDataFrame([(1, prose(60)), (2, None)], "id int, text string")
    got = {r.id: r.passages for r in with_passages(frame).collect()}
    assert got[2] == [] and [p.asDict() for p in got[1]] == passages(prose(60))


def test_white_space_beside_a_cut_stays_if_only_blanks_go():
    """A sentence that is cut behind a line break: the first passage keeps it, as the SQL's trim does."""
    text = "x" * 1199 + "\n" + "y" * 300
    assert [p["text"] for p in passages(text)] == ["x" * 1199, "y" * 300]
    got = passages(text, edges=" ")
    assert [(p["text"], p["from_char"], p["to_char"]) for p in got] == [("x" * 1199 + "\n", 0, 1200), ("y" * 300, 1200, 1500)]


def test_the_query_equals_its_sql_beside_a_cut(spark, tmp_path):
    import duckdb

    from lettermill.plans import catalogue

    texts = ["x" * 1199 + "\n" + "y" * 300, "x" * 1199 + " " + "y" * 300, "x" * 1200 + "\n" + "y" * 300 + "\n", "Yes. " + "x" * 1199 + "\ny"]
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("chunk_passages", "chunk_long"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalogue.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())

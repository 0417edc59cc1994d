import datetime as dt

from pyspark.sql import functions as F

from lettermill.operators.keys import extract_keys, new_keys

MESSAGE = "id int, message_id string, subject string, body string, sent_at timestamp, has_key boolean, kept_by_engine boolean"


def found(spark, rows, **kw):
    full = [(*r, *(None,) * (7 - len(r))) for r in rows]
    return sorted((r.email_id, r.value) for r in extract_keys(spark.createDataFrame(full, MESSAGE), **kw).collect())


def test_all_forms_and_no_end_boundary(spark):
    body = "100.113/26 and 100 114 - 27, 100115/245, 100.116/19, 99.117/26"
    assert found(spark, [(1, "m", "s", body)]) == [(1, "842.113/26"), (1, "842.114/27"), (1, "842.115/24")]


def test_subject_and_far_tail_of_the_body(spark):
    assert found(spark, [(1, "", "100.113/26", "x" * 50000 + " 100.114/26")]) == [(1, "842.113/26"), (1, "842.114/26")]
    assert found(spark, [(1, "", None, None)]) == []


def test_one_key_for_each_message_and_reference(spark):
    rows = [(k, "m", None, "100.113/26 100.113/26") for k in (1, 2, 3)]
    assert found(spark, rows) == [(1, "842.113/26")]
    assert found(spark, [(1, "", None, "100.113/26"), (2, None, None, "100.113/26")]) == [(1, "842.113/26"), (2, "842.113/26")]


def test_preference(spark):
    rows = [(1, "m", None, "100.113/26", None, False, False), (2, "m", None, "100.113/26", None, False, True), (3, "m", None, "100.113/26", None, True, False)]
    assert found(spark, rows) == [(3, "842.113/26")]
    assert found(spark, rows[:2]) == [(2, "842.113/26")]


def test_since_and_prefix(spark):
    rows = [(1, "a", None, "100.113/26", dt.datetime(2026, 1, 1)), (2, "b", None, "7.113/26", dt.datetime(2026, 1, 3))]
    assert found(spark, rows, since=F.lit(dt.datetime(2026, 1, 2)), written="7", prefix="R") == [(2, "R113/26")]


def test_upsert_is_idempotent(spark):
    keys = extract_keys(spark.createDataFrame([(1, "m", None, "100.113/26 100.114/26", None, None, None)], MESSAGE))
    assert new_keys(keys, keys).count() == 0
    assert [r.value for r in new_keys(keys.unionByName(keys), keys.where("value like '%113%'")).collect()] == ["842.114/26"]


def test_cut_bodies_and_the_log(spark, tmp_path):
    from lettermill.sources.tables import append, cut_bodies

    frame = spark.createDataFrame([(1, "m", "s", "é" * 5000, dt.datetime(2026, 1, 1), None, None), (2, "n", "s", None, dt.datetime(2025, 1, 1), None,
        None)], MESSAGE)
    assert [len(r.body) for r in cut_bodies(frame, F.lit(dt.datetime(2025, 6, 1))).collect()] == [4000]
    for _ in range(2):
        append(frame.select("id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_rows_are_distinct_pairs(spark):
    rows = [(k, f"m{k // 4}", None, f"100.{k // 8 + 100}/26 and 100.{k // 2 + 200}/25", None, k % 3 == 0, k % 5 == 0) for k in range(160)]
    got = extract_keys(spark.createDataFrame(rows, MESSAGE)).collect()
    pairs = {(r[1], v) for r in rows for v in (f"842.{r[0] // 8 + 100}/26", f"842.{r[0] // 2 + 200}/25")}
    assert len(got) == len(pairs) == len({(r.email_id // 4, r.value) for r in got})

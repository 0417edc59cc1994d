import datetime as dt

import pytest
from pyspark.sql import functions as F

from lettermill.operators import archive

SCHEMAS = {
    "attachments": "id int, message_id int, fingerprint string, name string, kind string, draft_or_final string, document_date date, stored_path string",
    "messages": "id int, received_at timestamp, subject string, sender string, recipients string",
    "message_files": "message_id int, file_id int",
    "files": "id int, job_id int",
    "jobs": "id int, reference string",
}


def attachment(i, message, fingerprint="f", name="a.pdf", day=None, path="/data/x"):
    return (i, message, fingerprint, name, "invoice", "final", day, path)


def message(i, day=1, sender="agent@haulier.co.uk", recipients="ops@example.com"):
    return (i, dt.datetime(2026, 8, day, 9) if day else None, "Shipment", sender, recipients)


def run(spark, attachments, messages, bridge=(), files=(), jobs=(), **kw):
    rows = {"attachments": attachments, "messages": messages, "message_files": bridge, "files": files, "jobs": jobs}
    tables = {k: spark.createDataFrame(list(v), SCHEMAS[k]) for k, v in rows.items()}
    return archive.archive(**tables, own_domain="example.com", **kw)


def test_four_copies_are_one_row(spark):
    got = run(spark, [attachment(i, i) for i in range(1, 5)], [message(i) for i in range(1, 5)]).collect()
    assert [(r.copies, r.id) for r in got] == [(4, 1)]


def test_two_days_are_one_row_and_one_name_two(spark):
    assert run(spark, [attachment(1, 1), attachment(2, 2)], [message(1, 1), message(2, 2)]).count() == 1
    assert run(spark, [attachment(1, 1, "a"), attachment(2, 1, "b")], [message(1)]).count() == 2


def test_openable_goes_before_newer_and_newest_among_openable(spark):
    got = run(spark, [attachment(1, 1), attachment(2, 2, path=None)], [message(1, 1), message(2, 9)]).first()
    assert (got.id, got.openable) == (1, True)
    assert run(spark, [attachment(1, 1), attachment(2, 2)], [message(1, 1), message(2, 9)]).first().id == 2


def test_null_day_of_receipt_comes_first(spark):
    assert run(spark, [attachment(1, 1), attachment(2, 2)], [message(1, 9), message(2, None)]).first().id == 2


@pytest.mark.parametrize(
    ("sender", "recipients", "want"),
    [
        ("agent@haulier.co.uk", "ops@example.com", "haulier.co.uk"), ("Ops@EXAMPLE.com", "x <b@port.it>, c@d.e", "port.it"),
        ("ops@example.com", "nobody", "example.com"), ("ops@example.com", None, "example.com"), (None, "a@b.c", None), ("nonsense", "a@b.c", ""),
    ],
)
def test_counterparty(spark, sender, recipients, want):
    assert run(spark, [attachment(1, 1)], [message(1, sender=sender, recipients=recipients)]).first().counterparty == want


def test_document_date_goes_before_receipt(spark):
    day = dt.date(2026, 1, 2)
    assert run(spark, [attachment(1, 1, day=day)], [message(1)]).first().happened_on == day
    assert run(spark, [attachment(1, 1)], [message(1, 3)]).first().happened_on == dt.date(2026, 8, 3)


def test_jobs_and_unfiled_documents(spark):
    got = run(spark, [attachment(1, 1, "a"), attachment(2, 2, "b")], [message(1), message(2)], [(1, 7)], [(7, 3)], [(3, "842.1/26")])
    assert {r.id: r.job_ref for r in got.collect()} == {1: "842.1/26", 2: None}


def test_attachment_without_message_is_dropped(spark):
    assert run(spark, [attachment(1, 99)], [message(1)]).count() == 0


def test_fan_out_counts_rows_or_attachments(spark):
    filed = ([(1, 1), (1, 2), (1, 3)], [(1, 1), (2, 2), (3, 3)], [(1, "a"), (2, "b"), (3, "c")])
    rows = run(spark, [attachment(1, 1), attachment(2, 1)], [message(1)], *filed).first()
    assert (rows.copies, rows.job_ref) == (6, "a")
    assert run(spark, [attachment(1, 1), attachment(2, 1)], [message(1)], *filed, copies="attachments").first().copies == 2


def test_null_fingerprints_are_one_document(spark):
    got = run(spark, [attachment(1, 1, None), attachment(2, 1, None), attachment(3, 1, "x")], [message(1)]).collect()
    assert sorted(r.copies for r in got) == [1, 2]


def test_filters_come_before_the_count(spark):
    got = run(spark, [attachment(1, 1, name="a"), attachment(2, 1, name="b")], [message(1)], filters=[F.col("name") == "b"]).first()
    assert (got.id, got.copies) == (2, 1)


def test_pages(spark):
    docs = run(spark, [attachment(i, i, f"f{i}", name=f"{i % 2}") for i in range(1, 8)], [message(i, 1 + i // 4) for i in range(1, 8)])
    pages = [[r.id for r in archive.page(docs, 3, k).collect()] for k in (0, 3, 6)]
    assert pages == [[4, 6, 5], [7, 2, 1], [3]]


def test_empty(spark):
    assert run(spark, [], []).count() == 0


def test_filings_are_reduced_before_they_meet_the_attachments(spark):
    """Two attachments of a message in three files (one without a job), one of a message in none."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "attachments": frame([(1, 1), (2, 1), (3, 2)], "id int, message_id int").selectExpr("*", "'f' as fingerprint", "'a' as name", "'k' as kind",
            "'final' as draft_or_final", "cast(null as date) as document_date", "'/x' as stored_path"),
        "messages": frame([(1,), (2,)], "id int").selectExpr("*", "timestamp'2026-01-01' as received_at", "'s' as subject", "'a@b.c' as sender", "'' as recipients"),
        "message_files": frame([(1, 7), (1, 8), (1, 9), (None, 7)], "message_id int, file_id int"),
        "files": frame([(7, 1), (8, 2), (9, None)], "id int, job_id int"),
        "jobs": frame([(1, "842.2"), (2, "842.1")], "id int, reference string"),
    }
    rows = archive.received_once(**tables, own_domain="x.y")
    assert sorted((r.id, r.job_ref, r.filed) for r in rows.collect()) == [(1, "842.1", 3), (2, "842.1", 3), (3, None, 1)]
    assert archive.received(**tables, own_domain="x.y").count() == 7
    got = archive.archive(**tables, own_domain="x.y").first()
    assert (got.id, got.job_ref, got.copies) == (1, "842.1", 7)
    assert archive.archive(**tables, own_domain="x.y", copies="attachments").first().copies == 3

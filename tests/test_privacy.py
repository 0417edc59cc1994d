import pytest
from pyspark.sql import functions as F

from lettermill.operators.privacy import gate, held_back_counts, is_confidential
from lettermill.sources.mail import payloads

OURS, THEIRS = "administration@example.com", "operations@haulier.co.uk"


def judge(spark, filename, subject=None, sender=None):
    frame = spark.createDataFrame([(filename, subject, sender)], "f string, s string, m string")
    return frame.select(is_confidential(F.col("f"), F.col("s"), F.col("m"))).first()[0]


CAUGHT = ["payslip_june.pdf", "PAY-SLIP.pdf", "pay slip.pdf", "Payroll.xlsx", "wage_slip.pdf", "salary statement.pdf", "P60.pdf", "my_p45_2025.pdf",
    "W-2_2025.pdf", "w2.pdf", "W 2.pdf", "form-16.pdf", "severance.doc", "attendance_sheet.xls", "timesheet.xls"]
PASS = ["invoice.pdf", "xp60.pdf", "p455.pdf", "W-2025.pdf", "new2.pdf", "delivery_note.pdf", "", None]


@pytest.mark.parametrize("name", CAUGHT)
def test_caught(spark, name):
    assert judge(spark, name) is True


@pytest.mark.parametrize("name", PASS)
def test_passes(spark, name):
    assert judge(spark, name) is False


@pytest.mark.parametrize(("subject", "sender", "want"), [("New  hire", OURS, True), ("New hire", THEIRS, False), ("sick leave", "x@example.evil.org",
    True), ("ETA", OURS, False), ("payroll", None, False), (None, OURS, False)])
def test_subject_counts_if_we_wrote(spark, subject, sender, want):
    assert judge(spark, "scan.pdf", subject, sender) is want


def test_held_back_payloads_are_never_opened(spark, tmp_path):
    (tmp_path / "note.txt").write_bytes(b"kept")
    rows = [("note.txt", "s", THEIRS, "m1", str(tmp_path / "note.txt")), ("payslip.pdf", "s", THEIRS, "m1", str(tmp_path / "missing")), (None, "s",
        THEIRS, "m2", "/nowhere"), ("pic.exe", "s", THEIRS, "m2", "/nowhere")]
    frame = spark.createDataFrame(rows, "filename string, subject string, sender string, mailbox string, path string")
    stored, held = payloads(frame, useful=r"(?i)\.(txt|pdf)$")
    assert [(r.filename, bytes(r.payload)) for r in stored.collect()] == [("note.txt", b"kept")]
    assert [(r.mailbox, r.held_back) for r in held_back_counts(held).collect()] == [("m1", 1)]
    assert gate(frame)[0].count() == 2

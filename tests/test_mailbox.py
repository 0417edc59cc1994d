import email
import random
from email.message import EmailMessage
from pathlib import Path

import pytest

from lettermill.sources import mailbox


def message(k, draw):
    """A message with parts inside parts, odd names and encodings."""
    m = EmailMessage()
    m["Message-ID"], m["From"], m["Subject"] = f"<{k}>", f"a{k}@example.com", f"Größe {k}"
    m.set_content("plain \n\nFrom here on\n" + "x" * draw.randint(0, 300), cte=draw.choice(["quoted-printable", "base64", "8bit"]))
    if draw.random() < 0.6:
        m.add_alternative("<p>ü</p>", subtype="html")
    for j in range(draw.randint(0, 3)):
        m.add_attachment(draw.randbytes(draw.randint(0, 2000)), maintype="application", subtype="pdf", filename=draw.choice(["note.pdf", "payslip.pdf",
            "größe €.pdf", "a b.txt"]) if j else "list.pdf")
    if draw.random() < 0.3:
        inner = EmailMessage()
        inner["Subject"] = "inner"
        inner.set_content("inside")
        inner.add_attachment(b"deep", maintype="text", subtype="x", filename="deep.txt")
        m.add_attachment(inner)
    return m.as_bytes()


def leaves(raw):
    return [(p.get_content_type(), mailbox.told(p.get_filename()), p.get_payload(decode=True)) for p in email.message_from_bytes(raw).walk()
        if not p.is_multipart()]


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    """Single files and mailboxes (one with CRLF), and what they hold."""
    folder, draw, want = tmp_path_factory.mktemp("mail"), random.Random(3), []
    (folder / "in").mkdir()
    for k in range(40):
        raw = message(k, draw)
        want += [(f"<{k}>", *x) for x in leaves(raw)]
        if k < 12:
            (folder / "in" / f"{k}.eml").write_bytes(raw)
        else:
            box = folder / f"{k % 2}.mbox"
            quoted = raw.replace(b"\n\nFrom ", b"\n\n>From ")
            entry = b"From x Thu Jan  1 00:00:00 2026\n" + quoted.rstrip(b"\n") + b"\n\n"
            with box.open("ab") as out:
                out.write(entry.replace(b"\n", b"\r\n") if k % 2 else entry)
    (folder / "empty.mbox").touch()
    (folder / ".hidden.eml").write_bytes(b"Subject: no\n\nx")
    return folder, want


@pytest.mark.parametrize("split", [700, 5000, 32 << 20])
def test_parts_are_those_of_the_standard_library(spark, landed, split):
    folder, want = landed
    found = mailbox.with_payload(mailbox.parts(spark, str(folder), split)).collect()
    plain = lambda b: b.replace(b"\r\n", b"\n").replace(b"\n>From ", b"\nFrom ").rstrip(b"\n")  # noqa: E731  mailboxes quote such lines
    got = sorted((r.message_id, r.content_type, r.filename or "", plain(bytes(r.payload))) for r in found)
    assert got == sorted((i, t, n or "", plain(p)) for i, t, n, p in want)
    assert {r.part for r in found} >= {"1", "2"} and any("." in r.part for r in found)
    assert all(r.subject == f"Größe {r.message_id[1:-1]}" for r in found if r.subject)


def test_large_mailboxes_are_read_by_several_tasks(spark, landed):
    assert mailbox.parts(spark, str(landed[0]), 2000).rdd.getNumPartitions() > 8


def test_nothing_held_back_is_decoded(spark, landed, tmp_path):
    folder, want = landed

    def decode(raw, encoding):
        import uuid

        out = mailbox.decoded(raw, encoding)
        Path(tmp_path, uuid.uuid4().hex).write_bytes(out)
        return out

    stored, held_back = mailbox.attachments(spark, str(folder), r"(?i)\.pdf$", decode=decode)
    names = sorted(r.filename for r in stored.collect())
    assert names == sorted(n for _, _, n, _ in want if n and n.endswith(".pdf") and n != "payslip.pdf")
    assert {r.filename for r in held_back.collect()} == {"payslip.pdf"}
    secret = {p for _, _, n, p in want if n == "payslip.pdf" and p}
    seen = {p.read_bytes() for p in tmp_path.iterdir()}
    assert secret and not secret & seen and len(list(tmp_path.iterdir())) == len(names)
    assert "payload" not in held_back.columns


@pytest.mark.parametrize(("raw", "rows"), [
    (b"", [("1", "text/plain", 0)]),
    (b"Subject: only headers", [("1", "text/plain", 0)]),
    (b"\nbody without headers", [("1", "text/plain", 20)]),
    (b"Content-Type: multipart/mixed; boundary=b\n\n--b\n\nunclosed", [("1", "text/plain", 8)]),
    (b"Content-Type: multipart/mixed; boundary=b\n\nno part", []),
    (b"Content-Type: multipart/mixed\n\nno boundary", [("1", "multipart/mixed", 11)]),
    (b"Content-Type: multipart/mixed; boundary=b\n\n--b\n\n\n--bb\nx\n--b--\n--b\n\nafter the end", [("1", "text/plain", 7)]),
])
def test_broken_messages(raw, rows):
    assert [(p.place, p.content_type, p.length) for p in mailbox.walk(raw, 0, len(raw))] == rows


def test_payload_encodings():
    assert mailbox.decoded(b"aGVs\r\nbG8", "base64") == b"hello" and mailbox.decoded(b"aGVsbG8=!!", "base64") == b"hello"
    assert mailbox.decoded(b"=C3=BC=\n", "quoted-printable") == "ü".encode() and mailbox.decoded(b"x=C3", "8bit") == b"x=C3"
    assert mailbox.decoded(b"", "base64") == b"" and mailbox.told("=?utf-8?q?gr=C3=B6=C3=9Fe?=") == "größe" and mailbox.told("=?no-such?q?x?=") == "=?no-such?q?x?="


def test_many_small_files_go_to_several_tasks(spark, tmp_path):
    for k in range(1600):
        (tmp_path / f"{k}.eml").write_bytes(b"Message-ID: <%d>\n\nx" % k)
    found = mailbox.parts(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 3 and found.count() == 1600


def test_packed_messages_are_as_they_were(spark, tmp_path):
    mail = [message(k, random.Random(k)) for k in range(30)] + [b"", b"Subject: s\n\n\n\nFrom here\n7\n"]
    assert [m for _, m in mailbox.unpacked(mailbox.packed(mail))] == mail
    (tmp_path / "1-50.mails").write_bytes(mailbox.packed(mail[:30]))
    found = mailbox.with_payload(mailbox.parts(spark, str(tmp_path))).collect()
    want = [(f"<{k}>", *x) for k, raw in enumerate(mail[:30]) for x in leaves(raw)]
    assert sorted((r.message_id, r.content_type, r.filename or "", bytes(r.payload)) for r in found) == sorted((i, t, n or "", p) for i, t, n, p in want)


def test_payloads_are_told_of_together(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.eml").write_bytes(b"Message-ID: <%d>\n\nbody %d" % (k, k))
    rows = mailbox.parts(spark, str(tmp_path)).coalesce(1)
    kept = mailbox.with_payload(rows).mapInArrow(lambda it: (b.slice(0, 1).select(["message_id"]) for b in it), "message_id string")
    batches = kept.count()
    assert batches == 1 and {bytes(r.payload) for r in mailbox.with_payload(rows).collect()} == {b"body %d" % k for k in range(20)}

import pickle

import pytest

from lettermill.sources import imap, mailbox


class Server:
    """Two folders; uid 7 is gone from the first. It refuses whatever is not reading."""

    def __init__(self, n=120, validity=5):
        self.n, self.validity, self.folder = n, validity, None

    def select(self, mailbox, readonly):
        assert readonly
        self.folder = mailbox.strip('"')
        return ("OK", [b"1"]) if self.folder in ("INBOX", "Sent items") else ("NO", [b"no such folder"])

    def response(self, code):
        return code, [str({"UIDVALIDITY": self.validity, "UIDNEXT": self.n + 1 if self.folder == "INBOX" else 4}[code]).encode()]

    def uid(self, command, *args):
        assert command == "FETCH" and args[1] == "(UID BODY.PEEK[])"
        lo, hi = map(int, args[0].split(":"))
        out = []
        for uid in range(lo, min(hi, self.n if self.folder == "INBOX" else 3) + 1):
            if uid != 7:
                raw = f"Message-ID: <{self.folder}.{uid}>\r\nSubject: s\r\n\r\nbody {uid}\r\n".encode()
                out += [(f"{uid} (UID {uid} BODY[] {{{len(raw)}}}".encode(), raw), b")"]
        return "OK", out

    def logout(self):
        return "BYE", []


def test_mail_lands_once(spark, tmp_path):
    pickle.dumps(Server())
    first = imap.land(spark, lambda: Server(100), ["INBOX", "Sent items"], str(tmp_path), range_size=30)
    assert sorted((r.folder, r.uid) for r in first.collect()) == [("INBOX", k) for k in range(1, 101) if k != 7] + [("Sent items", k) for k in (1, 2, 3)]
    more = imap.land(spark, lambda: Server(120), ["INBOX", "Sent items"], str(tmp_path), range_size=30)
    assert sorted((r.folder, r.uid) for r in more.collect()) == [("INBOX", k) for k in range(101, 121)]
    assert imap.land(spark, lambda: Server(120), ["INBOX"], str(tmp_path)).count() == 0
    found = mailbox.with_payload(mailbox.parts(spark, str(tmp_path))).collect()
    want = [f"<INBOX.{k}>" for k in range(1, 121) if k != 7] + [f"<Sent items.{k}>" for k in (1, 2, 3)]
    assert sorted(r.message_id for r in found) == sorted(want)
    assert {bytes(r.payload) for r in found} >= {b"body 1\r\n", b"body 120\r\n"}


def test_a_new_numbering_and_refusals(spark, tmp_path):
    imap.land(spark, lambda: Server(10), ["INBOX"], str(tmp_path))
    assert imap.land(spark, lambda: Server(10, 6), ["INBOX"], str(tmp_path)).count() == 9
    with pytest.raises(OSError, match="no such folder"):
        imap.land(spark, Server, ["Drafts"], str(tmp_path))


def test_a_request_lands_in_one_file_and_a_task_opens_a_folder_once(spark, tmp_path):
    opens = tmp_path / "opens"
    opens.mkdir()

    class Counted(Server):
        def select(self, mailbox, readonly):
            import uuid

            (opens / uuid.uuid4().hex).touch()
            return super().select(mailbox, readonly)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    imap.land(spark, lambda: Counted(2000), ["INBOX"], str(tmp_path / "mail"), range_size=100)
    files = [f for f in (tmp_path / "mail").rglob("*") if f.is_file() and f.name[:1] not in "_."]
    assert len(files) == 40 and all(f.suffix == ".mails" for f in files)
    found = mailbox.with_payload(mailbox.parts(spark, str(tmp_path / "mail"))).collect()
    assert sorted(bytes(r.payload) for r in found) == sorted(f"body {k}\r\n".encode() for k in range(1, 2001) if k != 7)
    assert len(list(opens.iterdir())) <= 21  # the driver's, and one for each task at most


def test_the_server_that_stands_in_knows_its_next_number(tmp_path, monkeypatch):
    """It listed all of its files whenever a task opened its folder."""
    from lettermill.plans import services
    from lettermill.sources import stores

    monkeypatch.setattr(stores, "files_below", None)
    server = services.FolderServer(str(tmp_path), 121)
    (tmp_path / "1.json").write_text('[{"uid": 51, "mail": "a"}, {"uid": 53, "mail": "b"}]')
    assert imap.opened(server, "INBOX").next == 121
    assert list(imap.fetched(server, 1, 52)) == [(51, b"a")] and list(imap.fetched(server, 53, 120)) == [(53, b"b")]

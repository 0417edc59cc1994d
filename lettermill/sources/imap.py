"""Landing the messages of a live mailbox, which is only ever read."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from lettermill.session import durable, ship
from lettermill.sources.mailbox import packed
from lettermill.sources.stores import open_store, read_bytes, write_whole

#: Messages that one request asks for.
AT_ONCE = 50
RANGE = 500
UID = re.compile(rb"UID (\d+)")


class Connection(Protocol):
    """What is used of ``imaplib.IMAP4`` after the login."""

    def select(self, mailbox: str, readonly: bool) -> tuple: ...
    def response(self, code: str) -> tuple: ...
    def uid(self, command: str, *args: str) -> tuple: ...
    def logout(self) -> tuple: ...


@dataclass(frozen=True)
class Opened:
    """A folder as it was opened: its numbering, and the number that comes next."""

    folder: str
    validity: int
    next: int


def opened(connection: Connection, folder: str) -> Opened:
    """Open a folder for reading only; raises if the server refuses."""
    status, said = connection.select(f'"{folder}"', readonly=True)
    if status != "OK":
        raise OSError(f"{folder}: {said}")
    number = lambda code: int((connection.response(code)[1] or [b"0"])[0] or 0)
    return Opened(folder, number("UIDVALIDITY"), number("UIDNEXT"))


def fetched(connection: Connection, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """``(uid, message)`` of a range of numbers (some may be gone). ``PEEK``
    leaves the messages as unread as they were."""
    status, items = connection.uid("FETCH", f"{lo}:{hi}", "(UID BODY.PEEK[])")
    if status != "OK":
        raise OSError(f"messages {lo} to {hi}: {items}")
    for item in items:
        if isinstance(item, tuple) and (found := UID.search(item[0])) and lo <= int(found[1]) <= hi:
            yield int(found[1]), item[1]


def _place(path: str, at: Opened) -> str:
    return f"{path}/{hashlib.sha256(at.folder.encode()).hexdigest()[:16]}-{at.validity}"


def _reached(place: str) -> int:
    store, inner = open_store(f"{place}/_next")
    return json.loads(read_bytes(f"{place}/_next"))["next"] if store.get_file_info(inner).type == fs.FileType.File else 1


def land(spark: SparkSession, connect: Callable[[], Connection], folders: list[str], path: str, range_size: int = RANGE) -> DataFrame:
    """Copy the messages of ``folders`` that are not yet below ``path`` to files
    ``<first>-<last>.mails`` there, one for each request, for ``mailbox.parts``
    to read: ``(folder, uid, n_bytes)`` of what came.

    ``connect`` opens a connection (``imaplib.IMAP4_SSL`` after its login); the
    driver opens one to ask how far each folder goes, and every task its own,
    which opens a folder once for all of the task's ranges that follow in it.
    Tasks take ranges of numbers and write each file whole, so a task that
    runs again writes the same. How far a folder was read is noted once all of
    it is there. A folder that the server has numbered anew is read from its
    start, to another place.
    """
    ship(spark)
    connection = connect()
    try:
        found = [opened(connection, f) for f in folders]
    finally:
        connection.logout()
    ranges = [(at.folder, at.validity, lo, min(lo + range_size, at.next) - 1) for at in found for lo in range(_reached(_place(path, at)), at.next, range_size)]
    asked = spark.createDataFrame(ranges, "folder string, validity long, lo long, hi long").repartition(max(1, min(len(ranges), 1000)), "folder", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = at = None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    connection = connection or connect()
                    at = at if at and at.folder == row["folder"] else opened(connection, row["folder"])
                    if at.validity != row["validity"]:
                        raise OSError(f"{at.folder} was numbered anew meanwhile")
                    for lo in range(row["lo"], row["hi"] + 1, AT_ONCE):
                        hi = min(lo + AT_ONCE - 1, row["hi"])
                        mail = list(fetched(connection, lo, hi))
                        got = [(at.folder, uid, len(message)) for uid, message in mail]
                        if got:
                            write_whole(f"{_place(path, at)}/{lo}-{hi}.mails", packed(message for _, message in mail))
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], ["folder", "uid", "n_bytes"])
        finally:
            if connection:
                connection.logout()

    landed = durable(asked.mapInArrow(run, "folder string, uid long, n_bytes long"), "landed")
    for at in found:
        write_whole(f"{_place(path, at)}/_next", json.dumps({"next": max(at.next, 1)}).encode())
    return landed

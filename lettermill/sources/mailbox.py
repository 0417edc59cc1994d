"""Landed mailboxes: the parts of every message by their place in the file, and
their payloads only behind the gate."""

from __future__ import annotations

import binascii
import quopri
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass
from email.header import decode_header, make_header
from email.message import Message
from email.parser import BytesHeaderParser
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from lettermill.operators.privacy import gate
from lettermill.session import ship
from lettermill.sources.stores import files_below, open_store

SPLIT_BYTES = 32 << 20
#: What a file costs besides its bytes, so that many small ones go to many tasks.
OPEN_BYTES = 1 << 16
#: Payloads that a task tells of together: rows, and bytes after which no more are added.
TOLD_ROWS, TOLD_BYTES = 256, 1 << 20
DEEPEST = 64
PARTS = ("file string, message_at long, message_id string, sender string, subject string, part string, content_type string, filename string, "
    "encoding string, begin long, length long")  # fmt: skip
#: Headers up to this size are looked up before they are parsed.
ALIKE_BYTES = 1024
START = re.compile(rb"(?:\A|(?<=\n\n)|(?<=\n\r\n))From ")
BLANK_LINE = re.compile(rb"\r?\n\r?\n")


@dataclass(frozen=True)
class Part:
    """A leaf of a message. ``place`` counts from 1 on every level ("2.1");
    ``begin`` and ``length`` are the bytes of its encoded payload in the file."""

    place: str
    content_type: str
    filename: str | None
    encoding: str
    begin: int
    length: int


def told(value: str | None) -> str | None:
    """A header's text with its encoded words decoded; as it stands, if they are broken."""
    if value is None:
        return None
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, UnicodeError, binascii.Error, ValueError):
        return str(value)


def headers(raw: bytes, lo: int, hi: int) -> tuple[Message, int]:
    """The headers that begin at ``lo``, and where the body does."""
    for end in (b"\n", b"\r\n"):
        if raw.startswith(end, lo):
            return Message(), lo + len(end)
    found = BLANK_LINE.search(raw, lo, hi)
    head, body = (raw[lo : found.start()], found.end()) if found else (raw[lo:hi], hi)
    return (_parsed(head) if len(head) <= ALIKE_BYTES else BytesHeaderParser().parsebytes(head)), body


@lru_cache(1024)
def _parsed(head: bytes) -> Message:
    """Headers, which are only read; those of parts are mostly alike."""
    return BytesHeaderParser().parsebytes(head)


def children(raw: bytes, lo: int, hi: int, boundary: str) -> Iterator[tuple[int, int]]:
    """The parts between a body's boundary lines; the line break before such a line belongs to it."""
    line = re.compile(rb"^--" + re.escape(boundary.encode("utf-8", "surrogateescape")) + rb"(--)?[ \t]*\r?$", re.M)
    begin = None
    for found in line.finditer(raw, lo, hi):
        if begin is not None:
            end = found.start() - 1
            yield begin, max(begin, end - (raw[end - 1 : end] == b"\r"))
        begin = None if found[1] else min(found.end() + 1, hi)
        if found[1]:
            return
    if begin is not None:
        yield begin, hi


def walk(raw: bytes, lo: int, hi: int, at: int = 0, place: str = "", depth: int = 0) -> Iterator[Part]:
    """The leaves of a message (or part) in ``raw[lo:hi]``, in order, nothing of
    them decoded. ``at`` is the place of ``raw`` in its file. Messages inside
    messages are walked too; below ``DEEPEST`` levels what is left is one leaf."""
    head, body = headers(raw, lo, hi)
    kind, boundary = head.get_content_type(), head.get_boundary()
    if kind.startswith("multipart/") and boundary and depth < DEEPEST:
        for k, (a, b) in enumerate(children(raw, body, hi, boundary), 1):
            yield from walk(raw, a, b, at, f"{place}.{k}" if place else str(k), depth + 1)
    elif kind == "message/rfc822" and depth < DEEPEST:
        yield from walk(raw, body, hi, at, f"{place}.1" if place else "1", depth + 1)
    else:
        encoding = str(head.get("Content-Transfer-Encoding", "7bit")).strip().lower()
        yield Part(place or "1", kind, told(head.get_filename()), encoding, at + body, hi - body)


def messages(read: Callable[[int, int], bytes], size: int, lo: int, hi: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of the messages of an mbox that begin in ``[lo, hi)``,
    which ends with the file or where the next begins. ``read`` takes a place
    and a length. A message begins with a line ``From ...`` behind an empty one."""
    begin = max(lo - 3, 0)
    data = read(begin, hi + 5 - begin)
    end = begin + len(data)
    starts = [begin + m.start() for m in START.finditer(data) if begin + m.start() >= lo and (m.start() or not begin)]
    mine = [s for s in starts if s < hi]
    later = [s for s in starts if s >= hi]
    while mine and not later and end < size:
        data += (more := read(end, step))
        later = [begin + m.start() for m in START.finditer(data, max(end - begin - 8, hi - begin)) if m.start()]
        end += len(more)
    for s, e in zip(mine, [*mine[1:], later[0] if later else end], strict=False):
        yield s, data[s - begin : e - begin]


def packed(mail: Iterable[bytes]) -> bytes:
    """Messages in a file, as they are: each behind a line that says how long it is."""
    return b"".join(b"%d\n%s" % (len(m), m) for m in mail)


def unpacked(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of the messages in a ``packed`` file."""
    at = 0
    while at < len(raw):
        begin = raw.index(b"\n", at) + 1
        at = begin + int(raw[at:begin])
        yield begin, raw[begin:at]


def rows_of(file: str, place: int, raw: bytes, in_mbox: bool) -> Iterator[tuple]:
    """The rows of one message."""
    lo = raw.find(b"\n") + 1 if in_mbox else 0
    head, _ = headers(raw, lo, len(raw))
    shown = (head.get("Message-ID") or "").strip() or None, told(head.get("From")), told(head.get("Subject"))
    for part in walk(raw, lo, len(raw), place):
        yield (file, place, *shown, *astuple(part))


@dataclass
class Ranges(InputPartition):
    """What a task reads: ``(file, size, from, to)``, whole files or a range of one."""

    ranges: list[tuple[str, int, int, int]]


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Ranges of ``split_bytes`` of large mailboxes; small files together, up to
        as many bytes, to which each file adds what it costs to open it."""
        out, held, size_held = [], [], 0
        for file, size in files_below(self.path):
            cuts = [0, size] if file.endswith((".eml", ".mails")) else [*range(0, max(size, 1), self.split), size]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and size_held + hi - lo > self.split:
                    out.append(Ranges(held))
                    held, size_held = [], 0
                held.append((file, size, lo, hi))
                size_held += hi - lo + OPEN_BYTES
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for file, size, lo, hi in partition.ranges:
            store, path = open_store(file)
            with store.open_input_file(path) as source:
                read = lambda at, n, source=source: source.read_at(max(0, min(n, size - at)), at)
                if file.endswith(".eml"):
                    yield from rows_of(file, 0, read(0, size), False)
                elif file.endswith(".mails"):
                    for place, raw in unpacked(read(0, size)):
                        yield from rows_of(file, place, raw, False)
                else:
                    for place, raw in messages(read, size, lo, hi):
                        yield from rows_of(file, place, raw, True)


class Mailboxes(DataSource):
    """``spark.read.format("mailboxes").load(folder)``: files that end in
    ``.eml`` hold a message, in ``.mails`` several (``packed``), others are
    mboxes. Option ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "mailboxes"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MailboxReader(self.options)


def parts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The leaf parts of all messages below ``path`` (see ``PARTS``), without
    their payloads: a row says where the encoded one lies. Large mailboxes are
    read in ranges by several tasks, each of which holds a range and the
    messages that begin in it. Empty files have no rows."""
    ship(spark)
    spark.dataSource.register(Mailboxes)
    return spark.read.format("mailboxes").option("split_bytes", split_bytes).load(path)


def decoded(raw: bytes, encoding: str) -> bytes:
    """A payload by its transfer encoding. Broken base64 is read as far as it goes."""
    if encoding == "base64":
        kept = re.sub(rb"[^A-Za-z0-9+/]", b"", raw)
        return binascii.a2b_base64(kept[: len(kept) - (len(kept) % 4 == 1)] + b"=" * (-len(kept) % 4 % 3))
    return quopri.decodestring(raw) if encoding == "quoted-printable" else raw


def with_payload(kept: DataFrame, decode: Callable[[bytes, str], bytes] = decoded) -> DataFrame:
    """Rows of ``parts`` with ``payload``. Each task opens the files of its own
    rows and reads their ranges, so the bytes of other parts are not even read."""
    schema = StructType([*kept.drop("payload").schema.fields, StructField("payload", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            told: list[bytes] = []
            size = begun = 0
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c)).to_pylist()
            for k, (file, begin, length, encoding) in enumerate(zip(*map(column, ("file", "begin", "length", "encoding")), strict=True)):
                if file != name:
                    if source:
                        source.close()
                    store, path = open_store(file)
                    name, source = file, store.open_input_file(path)
                told.append(decode(source.read_at(length, begin), encoding))
                size += len(told[-1])
                if len(told) == TOLD_ROWS or size >= TOLD_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begun, len(told)).columns, pa.array(told, pa.binary())], schema.names)
                    told, size, begun = [], 0, k + 1

    return kept.drop("payload").mapInArrow(run, schema)


def attachments(spark: SparkSession, path: str, useful: str | None = None, split_bytes: int = SPLIT_BYTES,
    decode: Callable[[bytes, str], bytes] = decoded) -> tuple[DataFrame, DataFrame]:
    """``(stored, held_back)``: the attachments (parts with a file name) below
    ``path`` that may be kept, with their payloads, and the others' rows. The
    gate looks at the file's name and at the message's subject and sender;
    nothing it holds back is decoded."""
    kept, held_back = gate(parts(spark, path, split_bytes), useful)
    return with_payload(kept, decode), held_back

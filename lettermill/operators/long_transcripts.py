"""Passages of transcripts that no task could hold, cut by many tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lettermill.operators.transcripts import MIN_PASSAGE, OVERLAP, SENTENCE_END, SIZE
from lettermill.session import durable, ship

BLOCK_CHARS = 4 << 20
#: So many blocks' facts, some MB, spare the texts another shuffle.
FEW_BLOCKS = 1 << 16
GAP = re.compile(SENTENCE_END)


class Cutter:
    """``transcripts.passages`` of a text that comes in stretches.

    What it holds is bounded: the open piece of the open sentence (and the white
    space behind it), the pieces of the open passage, and the last passage,
    which a short rest may still join. Offsets are told from the end of what was
    read, so equal states behave alike wherever they stand in a text.
    """

    def __init__(self, size: int = SIZE, overlap: int = OVERLAP, compat: bool = True, state: str | None = None, edges: str | None = None) -> None:
        self.size, self.overlap, self.compat, self.edges = size, overlap, compat, edges
        blank = {"started": False, "before": "", "open": "", "at": 0, "pieces": [], "carried": 0, "held": None}
        self.__dict__.update(json.loads(state) if state else blank)
        self.read, self.out = 0, []

    def state(self) -> str:
        """What a cutter needs to go on, for the stretch that begins where this one ends."""
        moved = lambda p: [p[0] - self.read, p[1]]
        return json.dumps({"started": self.started, "before": self.before, "open": self.open, "at": self.at - self.read, "carried": self.carried,
            "pieces": list(map(moved, self.pieces)), "held": moved(self.held) if self.held else None})

    def feed(self, text: str) -> None:
        skipped = 0
        if not self.started:
            skipped = len(text) - len(text := text.lstrip())
            self.started = bool(text)
            self.at = self.read + skipped
        self.read += skipped + len(text)
        if not self.started:
            return
        whole = self.before + self.open + text
        start, base = len(self.before), self.at - len(self.before)  # in whole; whole[k] stands at base + k
        for gap in GAP.finditer(whole, max(start - 1, 0) if self.before else 0):
            self._cut(whole, base, start, gap.start(), False)
            start = gap.end()
        start = self._cut(whole, base, start, len(whole.rstrip()), True)
        self.before, self.open, self.at = whole[max(start - 1, 0) : start], whole[start:], base + start

    def _cut(self, whole: str, base: int, start: int, end: int, more: bool) -> int:
        """The pieces of a sentence; of one that goes on (``more``) the full ones."""
        while start + self.size <= end if more else start < end:
            stop = min(start + self.size, end)
            self._add(base + start, whole[start:stop])
            start = stop
        return start

    def _add(self, at: int, text: str) -> None:
        self.pieces.append([at, text])
        if sum(len(t) + 1 for _, t in self.pieces) - 1 < self.size:
            return
        self._tell([self.pieces[0][0], " ".join(t for _, t in self.pieces).strip(self.edges)])
        keep, width = len(self.pieces), 0
        while keep - 1 > 0 and width < self.overlap:
            keep -= 1
            width += len(self.pieces[keep][1]) + 1
        self.pieces = self.pieces[keep:]
        self.carried = len(self.pieces)

    def _tell(self, passage: list | None) -> None:
        if self.held:
            self.out.append(self.held)
        self.held = passage

    def finish(self) -> None:
        """The text has ended."""
        last = self.open.rstrip()
        if last:
            self._add(self.at, last)
        left = " ".join(t for _, t in self.pieces).strip(self.edges) if self.compat or len(self.pieces) > self.carried else ""
        if left and len(left) < MIN_PASSAGE and self.held:
            self.held[1] = f"{self.held[1]} {left}".strip(self.edges)
        elif left:
            self._tell([self.pieces[0][0], left])
        self._tell(None)


def meet(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join where nulls are equal."""
    names = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    return left.join(right, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], how).drop(*names.values())


def few(facts: DataFrame) -> DataFrame:
    """``facts``, a row a block, sent to all tasks unless there are too many."""
    return F.broadcast(facts) if facts.count() <= FEW_BLOCKS else facts


def blocks_of(parts: DataFrame, doc: str, seq: str, text: str, block_chars: int) -> DataFrame:
    """``(doc, block, last, n, text)``: each transcript's consecutive stretches,
    numbered from 0 and cut behind ``block_chars`` characters or where a range of
    the sorted parts ends. The texts are dealt and written once."""
    rows = parts.select(F.col(doc).alias("doc"), F.col(seq).alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // max(block_chars, BLOCK_CHARS))), "doc", "seq").sortWithinPartitions("doc", "seq")
    dealt = dealt.select("doc", F.spark_partition_id().cast("long").alias("range"), "text")
    names = dealt.columns

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of each transcript in a range, which stand together, as blocks."""
        held, size, n, mine, doc = [], 0, 0, None, None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([mine, pa.array([(at << 32) + n]), pa.array(["".join(held)])], names)

        for batch in batches:
            for k, (d, at, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if mine is not None and (d != doc or size >= block_chars):
                    yield block()
                    held, size, n, mine = [], 0, n + 1, None
                if mine is None:
                    mine, doc = batch.column(0).slice(k, 1), d
                held.append(t)
                size += len(t)
        if mine is not None:
            yield block()

    ship(parts.sparkSession)
    schema = StructType([StructField("doc", rows.schema["doc"].dataType), StructField("range", dealt.schema["range"].dataType), StructField("text", StringType())])
    made = durable(dealt.mapInArrow(joined, schema), "blocks")
    order = Window.partitionBy("doc").orderBy("range")  # a row a block
    facts = made.select("doc", "range", F.length("text").cast("long").alias("n"))
    facts = facts.select("doc", "range", "n", (F.row_number().over(order) - 1).cast("int").alias("block"), F.lead("range").over(order).isNull().alias("last"))
    facts = durable(facts, "numbered")
    return meet(made, few(facts), "doc", "range").select("doc", "block", "last", "n", "text")


def long_passages(parts: DataFrame, doc: str = "doc", seq: str = "seq", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, compat: bool = True,
    block_chars: int = BLOCK_CHARS, edges: str | None = None) -> DataFrame:
    """``(doc, ordinal, text, from_char, to_char)``: the ``passages`` of
    transcripts that come in parts (``seq`` orders a transcript's parts, each
    once; the transcript is its parts one behind the other, nulls being empty).

    A transcript is cut into blocks, and every block begins from a state: what
    the passages before it have left open. At first all blocks begin from a
    blank one, so all can be cut at once. A block whose beginning turns out to
    be another, because the block before ended otherwise, is cut again, until
    none is. The first block of a transcript begins right, so the end is exact;
    and as passages soon fall into step whatever they began with, the second
    round mostly is the last. Of the first round only the passages of first
    blocks are kept, as the others' beginnings are guesses. A block's passages
    are written once a round and stay where they are; which round has the right
    ones is kept beside them, a row a block. A task holds a block. An empty
    table gives an empty result.
    """
    blocks = blocks_of(parts, doc, seq, text, block_chars)
    kind = blocks.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, block int, last boolean, n long, entry string, exit string, out array<struct<at:long,text:string>>"
    passage = pa.list_(pa.struct([("at", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                told = {c: row.column(row.schema.get_field_index(c))[0].as_py() for c in ("text", "block", "last", "entry", "n")}
                cutter = Cutter(size, overlap, compat, told["entry"], edges)
                cutter.feed(told["text"])
                if told["last"]:
                    cutter.finish()
                known = told["entry"] is not None or told["block"] == 0
                out = pa.array([[{"at": a, "text": t} for a, t in cutter.out] if known else None], passage)
                yield pa.RecordBatch.from_arrays([*(row.column(row.schema.get_field_index(c)) for c in ("doc", "block", "last")), pa.array([told["n"]], pa.int64()),
                    pa.array([told["entry"]], pa.string()), pa.array([cutter.state()]), out], ["doc", "block", "last", "n", "entry", "exit", "out"])

    def cut(some: DataFrame) -> DataFrame:
        return durable(some.select("doc", "block", "last", "n", "text", "entry").mapInArrow(run, schema), "cut")

    def known(made: DataFrame, turn: int) -> DataFrame:
        return made.select("doc", "block", "last", "n", "entry", "exit", F.size("out").alias("told"), F.lit(turn).alias("turn"))

    rounds = [cut(blocks.withColumn("entry", F.lit(None).cast("string")))]
    done = durable(known(rounds[0], 0), "known")
    while True:
        before = done.where("not last").select("doc", (F.col("block") + 1).alias("block"), F.col("exit").alias("right"))
        wrong = meet(done.select("doc", "block", "entry"), before, "doc", "block").where(~F.col("right").eqNullSafe(F.col("entry")))
        wrong = durable(wrong.select("doc", "block", F.col("right").alias("entry")), "wrong")
        if wrong.isEmpty():
            break
        rounds.append(cut(meet(blocks, wrong, "doc", "block")))
        again = known(rounds[-1], len(rounds) - 1)
        done = durable(meet(done, again.select("doc", "block"), "doc", "block", how="left_anti").unionByName(again), "known")

    order = Window.partitionBy("doc").orderBy("block")  # a row a block
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    facts = done.select("doc", "block", "turn", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("chars"), F.coalesce(F.sum("told").over(upto),
        F.lit(0)).alias("ordinal0"))
    facts = few(durable(facts, "facts"))
    rows = reduce(DataFrame.unionByName, (meet(made.select("doc", "block", "out"), facts.where(F.col("turn") == k), "doc", "block") for k, made
        in enumerate(rounds)))
    rows = rows.select("doc", "chars", "ordinal0", F.posexplode("out").alias("k", "p"))
    rows = rows.select("doc", (F.col("ordinal0") + F.col("k")).cast("int").alias("ordinal"), F.col("p.text").alias("text"), (F.col("chars") + F.col(
        "p.at")).alias("place"))
    begin = rows.where("ordinal = 0").select("doc", F.col("place").alias("begin"))  # the first passage begins with the stripped text
    rows = meet(rows, begin, "doc").select("doc", "ordinal", "text", (F.col("place") - F.col("begin")).cast("int").alias("from_char"))
    return rows.withColumn("to_char", F.col("from_char") + F.length("text"))

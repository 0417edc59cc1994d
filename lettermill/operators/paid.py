"""Paid calls from many tasks: leased before they are made, journalled before the next.

Amounts are whole billionths of a USD, so that sums are the same in any order.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.running import running_total
from lettermill.session import durable
from lettermill.sources.stores import open_store, read_bytes, write_whole

BILLION = 1_000_000_000


class BudgetSpent(Exception):
    """A run has come as far as its cap allows."""


def billionths(usd: float) -> int:
    return round(usd * BILLION)


def key_of(*what: str) -> str:
    return hashlib.sha256("\0".join(what).encode()).hexdigest()


@dataclass(frozen=True)
class Told:
    """What became of a call: a reply or an error and its cost; what calls may
    have cost that were begun before and never came back (``lost``); or that the
    task's lease did not allow it (``deferred``)."""

    reply: object = None
    error: str | None = None
    cost: int = 0
    lost: int = 0
    deferred: bool = False


@dataclass(frozen=True)
class Journal:
    """A folder of the shared store with a folder for every call: a file
    ``asked-*`` with the most it can cost, written before the call, and ``said``
    with the reply, written after it and before the next call. A task that runs
    again finds what was said and does not ask again. A call whose worker died
    has no reply, so it counts as lost and is made again: one for each worker."""

    folder: str

    def at(self, key: str) -> str:
        return f"{self.folder}/{key[:2]}/{key}"

    def look(self, key: str) -> tuple[Told | None, list[int]]:
        """What was said, if anything, and what each unanswered call may have cost."""
        store, path = open_store(self.at(key))
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None, []
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.base_name[:1] != "_"]
        said = json.loads(read_bytes(f"{self.at(key)}/said")) if "said" in names else None
        open_ = [n for n in names if n.startswith("asked-") and (said is None or n != said["by"])]
        lost = [int(n.rsplit("-", 1)[1]) for n in open_]
        return (Told(said["reply"], said["error"], said["cost"], sum(lost)) if said else None), lost

    def begin(self, key: str, most: int) -> str:
        name = f"asked-{uuid.uuid4().hex}-{most}"
        write_whole(f"{self.at(key)}/{name}", b"")
        return name

    def forget(self, key: str, by: str) -> None:
        store, path = open_store(f"{self.at(key)}/{by}")
        store.delete_file(path)

    def end(self, key: str, by: str, told: Told) -> None:
        write_whole(f"{self.at(key)}/said", json.dumps({"by": by, "reply": told.reply, "error": told.error, "cost": told.cost}).encode())


class Lease:
    """What a task may spend: the most that its calls so far can cost."""

    def __init__(self, journal: Journal) -> None:
        self.journal, self.leased, self.spent = journal, 0, 0

    def call(self, key: str, most: int, make: Callable[[], tuple[object, int]], keep_errors: bool = True) -> Told:
        """The reply of ``make``, which returns it with its cost, or what the
        journal has of it. A call that raises costs nothing; it is not repeated,
        or (without ``keep_errors``) the error is raised and it is not journalled.
        Where calls have cost more than was thought, or one was lost, the next
        is only made if what the others left over allows it."""
        self.leased += most
        told, before = self.journal.look(key)
        lost = sum(before)
        if told is None:
            most = max(before, default=most)  # the lease of a repeated call holds for the lost one too
            if self.spent + lost + most > self.leased:
                return Told(lost=lost, deferred=True)
            by = self.journal.begin(key, most)
            try:
                told = Told(*_reply(make), lost=lost)
            except Exception as e:
                if not keep_errors:
                    self.journal.forget(key, by)
                    raise
                told = Told(error=str(e), lost=lost)
            self.journal.end(key, by, told)
        self.spent += told.cost + told.lost
        return told


def _reply(make: Callable[[], tuple[object, int]]) -> tuple[object, None, int]:
    reply, cost = make()
    return reply, None, cost


def in_leases(rows: DataFrame, order: str, most: Column, cap: int, make: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], int, bool]:
    """Calls for ``rows`` in ``order``, by all tasks at once, never over ``cap``.

    ``most`` bounds what a row's call can cost. A wave takes as many rows as
    cannot cost more than what is left, all together; ``make`` gets them with a
    column ``most`` and returns rows with ``cost``, ``lost`` and ``deferred``;
    the next wave has what this one did not use. So a row is reached if what all
    before it cost and its own bound fit, whatever the number of tasks. Each
    wave leaves the share of the cap by which bounds exceed costs, so waves are
    few. Returns the waves' tables, what was spent, and whether all were reached.
    """
    placed = running_total(rows.withColumn("most", most.cast("long")), order, F.col("most"), "before")
    placed = durable(placed.withColumn("upto", F.col("before") + F.col("most")), "leases")
    total = placed.agg(F.max("upto").alias("n")).first()["n"] or 0.0
    made: list[DataFrame] = []
    spent, at = 0, 0.0
    while at < total:
        wave = placed.where((F.col("before") >= at) & (F.col("upto") <= at + cap - spent)).drop("before", "upto")
        end = placed.where(F.col("upto") <= at + cap - spent).agg(F.max("upto").alias("n")).first()["n"]
        if end is None or end <= at:
            return made, spent, False
        while wave is not None:
            done = durable(make(wave), "calls")
            made.append(done.where(~F.col("deferred")).drop("deferred"))
            got = done.agg(F.sum(F.when(~F.col("deferred"), F.col("cost") + F.col("lost"))).alias("spent"), F.count_if("deferred").alias("late"),
                F.sum(F.when(F.col("deferred"), F.col("most") + F.col("lost"))).alias("need")).first()
            spent, late = spent + (got["spent"] or 0), done.where("deferred")
            if not got["late"]:
                wave = None
            elif got["need"] <= cap - spent:
                wave = late.select(*[F.col("most") + F.col("lost") if c == "most" else F.col(c) for c in placed.drop("before", "upto").columns]).toDF(
                    *placed.drop("before", "upto").columns)
            else:  # what was lost took their lease
                stopped = late.withColumns({"error": F.lit("stopped by the cap")}) if "error" in done.columns else late
                made.append(stopped.drop("deferred"))
                return made, spent + (late.agg(F.sum("lost").alias("n")).first()["n"] or 0), False
        at = end
    return made, spent, True

"""Keyed state over streams: the key of each message and reference that copies
compete for, and verdicts that fall due by time alone."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from lettermill.operators.keys import CONFIDENCE, KIND, candidates
from lettermill.operators.state import OFFICE, SILENCE_DAYS, Dialect, shipment_state
from lettermill.session import ship
from lettermill.sources.versioned import VersionedTable, upsert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """State that does not fit an executor's memory is kept by RocksDB, which keyed state asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)


class Winner(StatefulProcessor):
    """Keeps the copy that has the key, and tells when it is another one."""

    def __init__(self, numbers: bool) -> None:
        self.numbers = numbers

    def rank(self, late: bool, spare: bool, ident: str) -> tuple:
        return late, spare, int(ident) if self.numbers else ident, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.won = handle.getValueState("won", "late boolean, spare boolean, id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = self.won.get() if self.won.exists() else None
        late, spare, _, ident = best = min(self.rank(r.late, r.spare, r.id) for r in rows)
        if had is None or best < self.rank(*had):
            self.won.update((late, spare, ident))
            yield Row(msg=key[0], value=key[1], id=ident, before=had[2] if had else None)

    def close(self) -> None:
        pass


def key_changes(messages: DataFrame) -> DataFrame:
    """``(msg, value, id, before)`` of arriving messages: the copy that a key
    goes to (see ``keys.extract_keys``), when it first appears and whenever a
    better copy comes, and the one that had it. Ids are told as text."""
    with_state(messages.sparkSession)
    numbers = isinstance(messages.schema["id"].dataType, IntegralType)
    rows = candidates(messages).withColumn("id", F.col("id").cast("string"))
    return rows.groupBy("msg", "value").transformWithState(Winner(numbers), "msg string, value string, id string, before string", "Update", "None")


def keep_keys(messages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the keys of arriving messages in the versioned table at ``target``:
    one for each message and reference, whatever the batches in which copies
    arrive. A batch that is repeated after a failure changes nothing.

    The best copy so far of each key is the state of a streaming aggregate, as
    the table needs no more; ``key_changes`` also tells who had a key before.
    """
    with_state(messages.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, target)
        rows = batch.select("msg", F.col("best.id").alias("email_id"), F.lit(KIND).alias("kind"), "value", F.lit(CONFIDENCE).alias("confidence"))
        if not table.exists():
            table.create(rows.limit(0), ["msg", "value"])
        table.update(f"{checkpoint}#{number}", rows, upsert(["msg", "value"]))

    best = candidates(messages).groupBy("msg", "value").agg(F.min(F.struct("late", "spare", "id")).alias("best"))
    return best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def kept_keys(spark: SparkSession, target: str) -> DataFrame:
    """The keys as ``extract_keys`` has them."""
    return VersionedTable(spark, target).read().select("email_id", "kind", "value", "confidence")


# Verdicts.


def verdict_plan(as_of: Column, silence_days: int = SILENCE_DAYS, dialect: Dialect = OFFICE) -> Column:
    """What the verdict on a shipment is on the day of ``as_of``, and on each
    later day on which it changes if nothing is heard: ``(day, state, reason)``
    in order. Only silence and a loading date can change it, so three days are
    looked at: when the one becomes too long (by either dialect's count), and
    the day after the other."""
    day, heard = F.to_date(as_of), F.to_date("last_message")
    due = F.coalesce("pickup_date", "goods_ready_date", "departure_date")
    days = F.array_compact(F.array(day, F.date_add(heard, silence_days + 1), F.date_add(heard, silence_days + 2), F.date_add(due, 1)))
    days = F.array_sort(F.array_distinct(F.filter(days, lambda d: d >= day)))
    told = F.transform(days, lambda d: F.struct(d.alias("day"), shipment_state(d, silence_days, dialect).alias("v")))
    flat = F.transform(told, lambda x: F.struct(x["day"].alias("day"), x["v"]["state"].alias("state"), x["v"]["reason"].alias("reason")))
    new = F.filter(F.sequence(F.lit(0), F.size(flat) - 1), lambda k: (k == 0) | (F.get(flat, k)["state"] != F.get(flat, k - 1)["state"]))
    return F.transform(new, lambda k: F.get(flat, k))


class Due(StatefulProcessor):
    """Holds a shipment's plan and tells each verdict on its day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.plan = handle, handle.getValueState("plan", "as_of long, plan string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((r.at, r.plan) for r in rows)
        if self.plan.exists():
            if tuple(self.plan.get()) >= newest:
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.plan.update(newest)
        first, *later = json.loads(newest[1])
        for entry in later:
            self.handle.registerTimer(_millis(entry["day"]))
        yield _said(key, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield from (_said(key, e) for e in json.loads(self.plan.get()[1]) if _millis(e["day"]) == at)

    def close(self) -> None:
        pass


def _millis(day: str) -> int:
    return int(datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.UTC).timestamp() * 1000)


def _said(key, entry: dict) -> Row:
    return Row(id=key[0], state=entry["state"], reason=entry["reason"], day=datetime.date.fromisoformat(entry["day"]))


def verdicts(shipments: DataFrame, as_of: str = "as_of", ident: str = "id", delay: str = "0 seconds", dialect: Dialect = OFFICE) -> DataFrame:
    """``(id, state, reason, day)`` of arriving shipment rows: the verdict when
    a row comes, and another whenever one falls due by time alone, so silence
    moves a shipment without a message. ``as_of`` is when a row was true; of
    several rows of a shipment the newest counts (of equals the one whose plan
    is last in order), and older ones that come late change nothing. Time is the
    stream's watermark, in UTC days."""
    with_state(shipments.sparkSession)
    rows = shipments.withWatermark(as_of, delay).select(ident, as_of, F.unix_micros(F.col(as_of).cast("timestamp")).alias("at"),
        F.to_json(verdict_plan(F.col(as_of), dialect=dialect)).alias("plan"))
    kind = shipments.schema[ident].dataType.simpleString()
    return rows.groupBy(ident).transformWithState(Due(), f"id {kind}, state string, reason string, day date", "Update", "EventTime")


DAY = 86_400_000_000


def keep_verdicts(shipments: DataFrame, target: str, log: str, checkpoint: str, as_of: str = "as_of", ident: str = "id",
    dialect: Dialect = OFFICE) -> StreamingQuery:
    """Keep the plan of each arriving shipment in the versioned table at
    ``target``, and tell the verdicts of each batch in a folder below ``log``
    (``batch=<number>``: ``ident, state, reason, day``).

    As in ``verdicts``, one is told when a row comes and another whenever one
    falls due by time alone, and of several rows of a shipment the newest counts.
    Time is the newest ``as_of`` so far, in UTC days; rows without one are left
    out. No shipment passes through Python: a batch is merged into the table, and
    what has fallen due since the version before is read from its plans, so a
    batch costs its own rows and one pass over the plans. A batch that is
    repeated after a failure merges nothing and tells the same.
    """
    now = F.unix_micros(F.col(as_of).cast("timestamp"))
    rows = shipments.where(F.col(as_of).isNotNull()).select(ident, now.alias("at"), verdict_plan(F.col(as_of), dialect=dialect).alias("plan"))

    def newest(rows: DataFrame) -> DataFrame:
        # a row that is sent again is not a newer one
        best = F.max_by(F.struct("at", "plan", "batch"), F.struct("at", F.to_json("plan"), -F.col("batch")))
        return rows.groupBy(ident).agg(best.alias("r")).select(ident, "r.*")

    def write(batch: DataFrame, number: int) -> None:
        table, run = VersionedTable(batch.sparkSession, target), f"{checkpoint}#{number}"
        changes = batch.withColumn("batch", F.lit(number).cast("long"))
        if not table.exists():
            table.create(changes.limit(0), [ident])
        table.update(run, newest(changes), lambda rows, more: newest(rows.unionByName(more)))
        version = table.manifest().runs.index(run)  # an update is a run and a version
        rows = table.read(table.manifest(version + 1))
        last, clock = (table.read(table.manifest(v)).agg(F.max("at")).first()[0] for v in (version, version + 1))
        fresh, due = F.col("batch") == number, lambda e: F.unix_date(e["day"]).cast("long") * DAY
        first = F.when(fresh, F.slice("plan", 1, 1)).otherwise(F.slice("plan", 1, 0))
        later = F.filter(F.slice("plan", 2, F.size("plan")), lambda e: (due(e) <= F.lit(clock)) & (fresh | (due(e) > F.lit(last))))
        told = rows.select(ident, F.inline(F.concat(first, later))).select(ident, "state", "reason", "day")
        told.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

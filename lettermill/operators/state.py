"""Where a shipment is, and which fact says so."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import falsy

# Fixed values
LOADED = ["loaded", "departed", "on_board", "berthed", "customs_cleared", "delayed"]
ARRIVED = ["delivered", "picked_up_by_consignee"]
PORTAL_LOADED = ["loaded", "departed", "on_board", "berthed", "cleared", "delayed"]
PORTAL_ARRIVED = ["delivered", "collected"]
SILENCE_DAYS = 15


@dataclass(frozen=True)
class Dialect:
    """The words of one of the two programs that give verdicts, and how it
    counts days of silence: by the calendar, or in whole periods of 24 hours."""

    loaded: tuple[str, ...]
    arrived: tuple[str, ...]
    missing: str
    said_delivered: str
    closed: str
    no_job: str
    collected: str
    said: str
    by_calendar: bool


# Both dialects' sentences, here and in the rules
OFFICE = Dialect(tuple(LOADED), tuple(ARRIVED), "None", "the correspondence says delivered", "job closed, fully invoiced and paid",
    "no job reference, nothing heard for ", "collected and paid: the job is closed", "the correspondence says ", True)
PORTAL = Dialect(tuple(PORTAL_LOADED), tuple(PORTAL_ARRIVED), "null", "correspondence says delivered", "job closed, invoiced and paid",
    "no job ref, nothing heard for ", "collected and paid", "correspondence says ", False)


def shipment_state(today: datetime.date, silence_days: int = SILENCE_DAYS, dialect: Dialect = OFFICE) -> Column:
    """A struct ``(state, reason)`` over the columns of a shipment; the first
    rule that holds decides. Proof comes first, then accounts, then silence,
    then what the correspondence says, then the schedule.

    The two dialects may differ in the state too: they know different travel
    states, and whole periods of 24 hours can be one fewer than calendar days.
    """
    c, day = F.col, F.lit(today).cast("date")
    verdict = lambda state, *reason: F.struct(F.lit(state).alias("state"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in reason]).alias("reason"))
    settled_up = (F.coalesce(c("revenue_to_invoice"), F.lit(0)) == 0) & (F.coalesce(c("cost_to_receive"), F.lit(0)) == 0)
    if dialect.by_calendar:
        silent = F.datediff(day, F.to_date("last_message"))
    else:
        silent = F.floor((F.unix_micros(F.lit(today).cast("timestamp")) - F.unix_micros(c("last_message").cast("timestamp"))) / F.lit(86_400_000_000))
    quiet = F.coalesce(silent > silence_days, F.lit(False))
    due = F.coalesce("pickup_date", "goods_ready_date", "departure_date")
    heard = F.when(falsy(c("travel_state")), F.lit("")).otherwise(F.concat(F.lit(", last we heard: "), c("travel_state")))
    return (
        F.when(c("proof_date").isNotNull(), verdict("delivered", "arrival document (", F.coalesce("proof_kinds", F.lit(dialect.missing)), ") dated ",
            c("proof_date").cast("string")))
        .when(c("travel_state").isin(*dialect.arrived), verdict("delivered", dialect.said_delivered))
        .when((c("job_status") == "closed") & settled_up, verdict("settled", dialect.closed))
        .when(quiet & falsy(c("job_ref")), verdict("archived", dialect.no_job, silent.cast("string"), " days"))
        .when(quiet, verdict("unclear", "job open, nothing heard for ", silent.cast("string"), " days", heard))
        .when(F.coalesce(c("fully_settled"), F.lit(False)) & settled_up, verdict("settled", dialect.collected))
        .when(c("travel_state").isin(*dialect.loaded), verdict("in_transit", dialect.said, c("travel_state")))
        .when(due < day, verdict("loading_overdue", "loading due ", due.cast("string"), ", no departure recorded"))
        .when(due.isNotNull(), verdict("awaiting_loading", "loading due ", due.cast("string")))
        .when(F.coalesce(c("line_count"), F.lit(0)) == 0, verdict("awaiting_loading", "job just opened, nothing filled in yet"))
        .otherwise(verdict("awaiting_loading", "no loading date yet"))
    )

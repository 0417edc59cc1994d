import datetime as dt
from decimal import Decimal

import pytest

from lettermill.operators.state import PORTAL, shipment_state

TODAY = dt.date(2026, 9, 10)
SCHEMA = "proof_date date, proof_kinds string, travel_state string, job_status string, job_ref string, fully_settled boolean, revenue_to_invoice decimal(18,2), cost_to_receive decimal(18,2), last_message timestamp, pickup_date date, goods_ready_date date, departure_date date, line_count int"
BASE = dict(proof_date=None, proof_kinds=None, travel_state=None, job_status="open", job_ref="842.113/26", fully_settled=False,
    revenue_to_invoice=Decimal(0), cost_to_receive=Decimal(0), last_message=dt.datetime(2026, 9, 9, 10), pickup_date=None, goods_ready_date=None,
    departure_date=None, line_count=3)
D = dt.date
ago = lambda n: dt.datetime(2026, 9, 10, 23) - dt.timedelta(n)

CASES = [
    (dict(proof_date=D(2026, 9, 1), proof_kinds="cmr", job_status="closed"), "delivered", "arrival document (cmr) dated 2026-09-01"),
    (dict(proof_date=D(2026, 9, 1)), "delivered", "arrival document (None) dated 2026-09-01"),
    (dict(travel_state="picked_up_by_consignee", last_message=ago(99)), "delivered", "the correspondence says delivered"),
    (dict(job_status="closed", travel_state="departed"), "settled", "job closed, fully invoiced and paid"),
    (dict(job_status="closed", revenue_to_invoice=None, cost_to_receive=None), "settled", "job closed, fully invoiced and paid"),
    (dict(job_status="closed", revenue_to_invoice=Decimal(-1)), "awaiting_loading", "no loading date yet"),
    (dict(last_message=ago(16), job_ref=""), "archived", "no job reference, nothing heard for 16 days"),
    (dict(last_message=ago(16), job_ref=None), "archived", "no job reference, nothing heard for 16 days"),
    (dict(last_message=ago(16), travel_state="loaded"), "unclear", "job open, nothing heard for 16 days, last we heard: loaded"),
    (dict(last_message=ago(16), fully_settled=True), "unclear", "job open, nothing heard for 16 days"),
    (dict(last_message=ago(15), travel_state="loaded"), "in_transit", "the correspondence says loaded"),
    (dict(fully_settled=True, travel_state="departed"), "settled", "collected and paid: the job is closed"),
    (dict(fully_settled=True, cost_to_receive=Decimal(5), travel_state="customs_cleared"), "in_transit", "the correspondence says customs_cleared"),
    (dict(travel_state="cleared"), "awaiting_loading", "no loading date yet"),
    (dict(pickup_date=D(2026, 9, 9), departure_date=D(2026, 9, 20)), "loading_overdue", "loading due 2026-09-09, no departure recorded"),
    (dict(goods_ready_date=D(2026, 9, 10)), "awaiting_loading", "loading due 2026-09-10"),
    (dict(last_message=None, line_count=0), "awaiting_loading", "job just opened, nothing filled in yet"),
    (dict(line_count=None), "awaiting_loading", "job just opened, nothing filled in yet"),
    (dict(), "awaiting_loading", "no loading date yet"),
]


def test_rules_in_order(spark):
    rows = [tuple((BASE | c)[f.split()[0]] for f in SCHEMA.split(", ")) for c, _, _ in CASES]
    got = spark.createDataFrame(rows, SCHEMA).coalesce(1).select(shipment_state(TODAY).alias("v")).collect()
    assert [(r.v.state, r.v.reason) for r in got] == [(s, w) for _, s, w in CASES]


@pytest.mark.parametrize("column", list(BASE))
def test_there_is_always_a_reason(spark, column):
    row = BASE | {column: None}
    v = spark.createDataFrame([tuple(row[f.split()[0]] for f in SCHEMA.split(", "))], SCHEMA).select(shipment_state(TODAY).alias("v")).first().v
    assert v.state and v.reason


PORTAL_CASES = [
    (dict(proof_date=D(2026, 9, 1)), "delivered", "arrival document (null) dated 2026-09-01"),
    (dict(travel_state="collected"), "delivered", "correspondence says delivered"),
    (dict(travel_state="picked_up_by_consignee"), "awaiting_loading", "no loading date yet"),
    (dict(job_status="closed"), "settled", "job closed, invoiced and paid"),
    (dict(last_message=dt.datetime(2026, 8, 25, 1), travel_state="cleared"), "in_transit", "correspondence says cleared"),  # 15 days and 23 hours
    (dict(last_message=dt.datetime(2026, 8, 25, 0), job_ref=None), "archived", "no job ref, nothing heard for 16 days"),
    (dict(last_message=dt.datetime(2026, 8, 25, 0), travel_state="loaded"), "unclear", "job open, nothing heard for 16 days, last we heard: loaded"),
    (dict(fully_settled=True), "settled", "collected and paid"),
    (dict(pickup_date=D(2026, 9, 9)), "loading_overdue", "loading due 2026-09-09, no departure recorded"),
]


def test_the_portal(spark):
    rows = [tuple((BASE | c)[f.split()[0]] for f in SCHEMA.split(", ")) for c, _, _ in PORTAL_CASES]
    got = spark.createDataFrame(rows, SCHEMA).coalesce(1).select(shipment_state(TODAY, dialect=PORTAL).alias("v")).collect()
    assert [(r.v.state, r.v.reason) for r in got] == [(s, w) for _, s, w in PORTAL_CASES]

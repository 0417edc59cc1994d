import datetime as dt

import pytest

from lettermill.operators.keys import extract_keys
from lettermill.operators.state import shipment_state
from lettermill.streaming.keyed import keep_keys, keep_verdicts, kept_keys, verdicts
from lettermill.streaming.mail import arriving

MAIL = "id int, message_id string, subject string, body string, has_key boolean, kept_by_engine boolean"
BATCHES = [
    [(5, "m", "100.113/26", None, False, False), (6, "m", "100.114/26", None, False, False), (7, None, "100.113/26", "100.113/26", None, None)],
    [(3, "m", "x", "100.113/26", False, False), (9, "m", "100.114/26", None, False, True), (10, "n", "none", "", None, None)],
    [(4, "m", "100.113/26", None, False, False), (12, "m", "100.114/26", None, True, False), (11, "", "100.115/27", None, None, None)],
]


def test_a_copy_in_a_later_batch_adds_no_row(spark, tmp_path):
    source, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    seen = []
    for batch in BATCHES:
        rows = spark.createDataFrame(batch, MAIL)
        rows.write.mode("append").parquet(source)
        keep_keys(arriving(spark, source, rows.schema), target, checkpoint).awaitTermination()
        seen += batch
        want = sorted(map(tuple, extract_keys(spark.createDataFrame(seen, MAIL)).collect()))
        assert sorted(map(tuple, kept_keys(spark, target).collect())) == want
    # all of it again, by a stream that knows nothing
    keep_keys(arriving(spark, source, rows.schema, 1), str(tmp_path / "new"), str(tmp_path / "check2")).awaitTermination()
    assert sorted(map(tuple, kept_keys(spark, str(tmp_path / "new")).collect())) == want


FACTS = ("id long, proof_date date, proof_kinds string, travel_state string, job_status string, job_ref string, revenue_to_invoice decimal(18,2), "
    "cost_to_receive decimal(18,2), fully_settled boolean, last_message timestamp, pickup_date date, goods_ready_date date, departure_date date, "
    "line_count int, as_of timestamp")  # fmt: skip


def shipment(ident, day, heard=None, ref=None, travel=None, due=None, proof=None):
    return (ident, proof, None, travel, "open", ref, None, None, None, heard, due, None, None, 1, dt.datetime(2026, 3, day, 6))


def day(n, hour=0):
    return dt.datetime(2026, 3, n, hour)


@pytest.mark.parametrize("until", [17, 20, 30])
def test_silence_alone_moves_a_shipment(spark, tmp_path, until):
    source = str(tmp_path / "in")
    rows = [
        [shipment(1, 2, day(1, 9)), shipment(2, 2, day(1, 9), "842.1"), shipment(3, 2, day(1), travel="loaded"), shipment(4, 2, None, due=dt.date(2026, 3, 10)),
            shipment(5, 2, day(2), "842.5", due=dt.date(2026, 3, 25)), shipment(6, 2, day(2), proof=dt.date(2026, 3, 1)), shipment(7, 2)],
        [shipment(2, 10, day(9), "842.1"), shipment(3, 11, day(11), "842.3", "loaded"), shipment(4, 1, due=dt.date(2026, 3, 3))],
        [shipment(-1, until)],
    ]
    told = {}

    def keep(batch, _):
        for r in batch.collect():
            told.setdefault(r.id, []).append((r.day, r.state, r.reason))

    for k, batch in enumerate(rows):
        frame = spark.createDataFrame(batch, FACTS)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = verdicts(arriving(spark, source, frame.schema)).writeStream.outputMode("update").foreachBatch(keep)
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    newest = {r[0]: r for batch in rows for r in batch if r[0] > 0 and not (r[0] == 4 and r[-1].day == 1)}
    state = shipment_state(dt.date(2026, 3, until)).alias("v")
    want = {r.id: r.v.state for r in spark.createDataFrame(list(newest.values()), FACTS).select("id", state).collect()}
    assert {k: max(v)[1] for k, v in told.items() if k > 0} == want
    if until == 30:
        assert told[1][-1] == (dt.date(2026, 3, 17), "archived", "no job reference, nothing heard for 16 days")
        assert [(d.day, s) for d, s, _ in told[2]][-1] == (25, "unclear") and [s for _, s, _ in told[4]] == ["awaiting_loading", "loading_overdue"]


def test_keys_are_kept_without_a_worker_for_each(spark, tmp_path, monkeypatch):
    """The state is Spark's own aggregate, so no key is passed to Python."""
    from lettermill.streaming import keyed

    monkeypatch.setattr(keyed, "Winner", None)
    rows = spark.createDataFrame(BATCHES[0], MAIL)
    rows.write.parquet(str(tmp_path / "in"))
    keep_keys(arriving(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, kept_keys(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, extract_keys(rows).collect()))


def test_verdicts_are_kept_without_a_worker_for_each(spark, tmp_path, monkeypatch):
    """Each is told once, when its row comes or on its day; no shipment is passed
    to Python."""
    from lettermill.streaming import keyed

    monkeypatch.setattr(keyed, "Due", None)
    silent = shipment(1, 2, day(1, 9))
    batches = [
        [silent, shipment(2, 2, day(1, 9), "842.1"), shipment(4, 2, None, due=dt.date(2026, 3, 10)), shipment(4, 1, None, due=dt.date(2026, 3, 3)),
            shipment(6, 2, day(2), proof=dt.date(2026, 3, 1)), shipment(7, 2)],
        [shipment(2, 10, day(9), "842.1"), shipment(4, 1, due=dt.date(2026, 3, 3)), silent],
        [shipment(-1, 16)], [shipment(-1, 17)], [shipment(-1, 30), shipment(8, 5, day(1, 9))],
    ]
    source, target, log = (str(tmp_path / n) for n in ("in", "plans", "log"))

    for batch in batches:
        frame = spark.createDataFrame(batch, FACTS)
        frame.coalesce(1).write.mode("append").parquet(source)
        keep_verdicts(arriving(spark, source, frame.schema), target, log, str(tmp_path / "check")).awaitTermination()
    told = sorted((r.batch, r.id, r.state, r.day.day) for r in spark.read.parquet(log).where("id > 0").collect())
    assert told == [
        (0, 1, "awaiting_loading", 2), (0, 2, "awaiting_loading", 2), (0, 4, "awaiting_loading", 2), (0, 6, "delivered", 2), (0, 7, "awaiting_loading", 2),
        (1, 2, "awaiting_loading", 10), (2, 4, "loading_overdue", 11), (3, 1, "archived", 17), (4, 2, "unclear", 25), (4, 8, "archived", 17),
        (4, 8, "awaiting_loading", 5),
    ]

import random

import pytest

from lettermill.operators import threads
from lettermill.operators.growing import GrowingClusters

EMAILS = "id long, message_id string, in_reply_to string, references string, subject_key string, ingest_order long"
KEYS = "email_id long, kind string, value string"


def corpus(seed, n=70):
    """Messages whose keys and subjects pass their caps on the way, copies, and replies to what comes later."""
    draw = random.Random(seed)
    emails, keys = [], []
    for k in range(n):
        reply = f"<{draw.randrange(n + 5)}>" if draw.random() < 0.15 else None
        emails.append((k, f"<{draw.randrange(n)}>" if draw.random() < 0.1 else f" <{k}> ", reply, None, draw.choice(["a long subject", "another subject",
            "confirmation", "info", None, f"subject number {k}"]) if draw.random() < 0.3 else "", draw.choice([None, k])))
        for _ in range(draw.choice([0, 1, 1, 2])):
            keys.append((k, draw.choice(["job", "ref", "weak"]), str(draw.randrange(12))))
    draw.shuffle(emails)
    return emails, keys


def whole(spark, emails, keys, most, most_subject):
    frame, refs = spark.createDataFrame(emails, EMAILS), spark.createDataFrame(keys, KEYS)
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    rules = [threads.reference_edges(frame, refs, most=most), threads.reply_edges(frame), threads.subject_edges(frame, most_subject)]
    parts = threads.connected_components(reduce(DataFrame.unionByName, rules)).withColumnRenamed("node", "id")
    return sorted(map(tuple, frame.join(parts, "id", "left").select("id", F.coalesce("component", "id")).collect()))


@pytest.mark.parametrize(("seed", "batches"), [(1, 4), (2, 3)])
def test_batches_end_in_the_clusters_of_all(spark, tmp_path, seed, batches):
    emails, keys = corpus(seed)
    made = GrowingClusters(spark, str(tmp_path), 5, 4)
    step = -(-len(emails) // batches)
    for k in range(batches):
        part = emails[k * step : (k + 1) * step]
        mine = {e[0] for e in part}
        batch = spark.createDataFrame(part, EMAILS), spark.createDataFrame([x for x in keys if x[0] in mine], KEYS)
        made.add(f"b{k}", *batch)
        if k == 1:
            made.add(f"b{k}", *batch)  # again
    assert sorted(map(tuple, made.clusters().collect())) == whole(spark, emails, keys, 5, 4)


def test_a_key_over_its_cap_parts_its_cluster(spark, tmp_path):
    made = GrowingClusters(spark, str(tmp_path), 3, 3)
    mail = lambda ids: spark.createDataFrame([(k, None, None, None, "", k) for k in ids], EMAILS)
    refs = lambda ids: spark.createDataFrame([(k, "job", "x") for k in ids], KEYS)
    made.add("a", mail([1, 2]), refs([1, 2]))
    made.add("b", mail([3, 9]), refs([3]))
    assert sorted(map(tuple, made.clusters().collect())) == [(1, 1), (2, 1), (3, 1), (9, 9)]
    made.add("c", mail([4]), refs([4]))
    assert sorted(map(tuple, made.clusters().collect())) == [(k, k) for k in (1, 2, 3, 4, 9)]


def test_a_message_that_comes_again_is_replaced(spark, tmp_path):
    """Its former keys no longer link it, nor fill a cap: in this batch or in later ones."""
    made = GrowingClusters(spark, str(tmp_path), 3, 3)
    mail = lambda ids: spark.createDataFrame([(k, f"<{k}>", None, None, "", k) for k in ids], EMAILS)
    refs = lambda rows: spark.createDataFrame([(k, "job", v) for k, v in rows], KEYS)
    made.add("a", mail([1, 2, 3, 9]), refs([(1, "x"), (2, "x"), (3, "x"), (9, "y")]))
    made.add("b", mail([3]), refs([(3, "y")]))
    assert sorted(map(tuple, made.clusters().collect())) == [(1, 1), (2, 1), (3, 3), (9, 3)]
    made.add("c", mail([4]), refs([(4, "x")]))
    assert sorted(map(tuple, made.clusters().collect())) == [(1, 1), (2, 1), (3, 3), (4, 1), (9, 3)]


def test_a_batch_that_failed_half_way_is_taken_whole(spark, tmp_path, monkeypatch):
    made = GrowingClusters(spark, str(tmp_path), 3, 3)
    mail = lambda ids: spark.createDataFrame([(k, None, None, None, "", k) for k in ids], EMAILS)
    refs = lambda ids: spark.createDataFrame([(k, "job", "x") for k in ids], KEYS)
    made.add("a", mail([1, 2]), refs([1, 2]))
    with monkeypatch.context() as m, pytest.raises(KeyError):
        m.setattr(made.mails, "update", lambda *_: {}["gone"])
        made.add("b", mail([3, 4]), refs([3, 4]))
    made.add("b", mail([3, 4]), refs([3, 4]))
    assert sorted(map(tuple, made.clusters().collect())) == [(k, k) for k in (1, 2, 3, 4)]


def test_what_a_batch_does_not_touch_is_neither_read_into_links_nor_written(spark, tmp_path, monkeypatch):
    """The links of a batch are those of its own keys, however large the cluster
    that it meets, and postings of earlier batches are not written again (F11)."""
    from lettermill.operators import growing

    made, seen = GrowingClusters(spark, str(tmp_path), 120, 60), []
    real = growing.connected_components
    monkeypatch.setattr(growing, "connected_components", lambda links: seen.append(links.count()) or real(links))
    mail = lambda ids: spark.createDataFrame([(k, f"<{k}>", f"<{k - 1}>", None, "", k) for k in ids], EMAILS)
    none = spark.createDataFrame([], KEYS)
    made.add("a", mail(range(500)), none)
    first = set(made.postings.manifest().buckets.values())
    made.add("b", mail([500]), none)
    assert seen[0] >= 499 and seen[1] <= 2
    assert {f for held in made.postings.manifest().buckets.values() for f in held.split("+")} >= first
    assert {c for _, c in made.clusters().collect()} == {0}

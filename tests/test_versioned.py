import threading

import pytest
from pyspark.sql import functions as F

from lettermill.sources.versioned import Conflict, VersionedTable, upsert


def table(spark, path, n=100):
    return VersionedTable(spark, str(path)).create(spark.range(n).selectExpr("id", "cast(0 as long) as n"), ["id"], 8)


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def add(have, changes):
    """Adds what the changes say to each row: lost updates show."""
    mine = changes.groupBy("id").agg(F.sum("more").alias("more"))
    return have.join(mine, "id", "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def test_versions_and_repeated_runs(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    with pytest.raises(Conflict):
        table(spark, tmp_path / "t")
    changes = spark.createDataFrame([(3, 5), (200, 1)], "id long, more long")
    first = t.update("a", changes, add)
    assert first.version == 1 and dict(rows(t))[3] == 5 and len(rows(t)) == 100
    assert t.update("a", changes, add) == first and rows(t)[3] == (3, 5)
    t.update("b", spark.createDataFrame([(3, 7), (500, 9)], "id long, n long"), upsert(["id"]))
    assert dict(rows(t)) == {k: 0 for k in range(100)} | {3: 7, 500: 9}
    assert sorted(map(tuple, t.read(first).collect()))[3] == (3, 5)  # an older version is still there
    assert t.update("none", changes.limit(0), add).version == 3
    folders = lambda: {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()}
    had, used = folders(), set(t.manifest().buckets.values())
    assert t.vacuum(1) == len(had - used) and folders() == used and dict(rows(t))[500] == 9


def test_untouched_buckets_are_not_written(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    before = t.manifest().buckets
    after = t.update("a", spark.createDataFrame([(3, 5)], "id long, more long"), add).buckets
    assert sum(before[k] != after[k] for k in before) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    """A second writer comes between reading and claiming, to the same bucket or to another."""
    for same in (True, False):
        t = table(spark, tmp_path / f"t{same}")
        calls = []

        def merge(have, changes, t=t, same=same, calls=calls):
            calls.append(1)
            if len(calls) == 1:
                VersionedTable(spark, t.path).update("other", spark.createDataFrame([(3 if same else 4, 10)], "id long, more long"), add)
            return add(have, changes)

        t.update("mine", spark.createDataFrame([(3, 5)], "id long, more long"), merge)
        got = dict(rows(t))
        assert (got[3], got[4]) == ((15, 0) if same else (5, 10)) and t.manifest().runs == ["other", "mine"]
        assert len(calls) == (2 if same else 1) or not same


def test_many_writers_at_once(spark, tmp_path):
    t = table(spark, tmp_path / "t", 4)
    failed = []

    def work(k):
        try:
            VersionedTable(spark, t.path).update(f"w{k}", spark.createDataFrame([(0, 1), (k % 4, 1)], "id long, more long"), add)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and sum(n for _, n in rows(t)) == 12 and t.manifest().version == 6


def test_an_empty_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t")).create(spark.range(0).selectExpr("id", "id as n"), ["id"])
    assert t.read().count() == 0
    t.update("a", spark.createDataFrame([(1, 2)], "id long, n long"), upsert(["id"]))
    assert rows(t) == [(1, 2)]


def test_appended_rows_leave_what_is_there(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "a")).create(spark.range(100).selectExpr("id", "cast(0 as long) as n"), ["id"], 4)
    before, rows = t.manifest().buckets, lambda k: spark.range(100 * k, 100 * k + 100).selectExpr("id", "cast(1 as long) as n")
    for k in range(1, 12):
        t.append(f"r{k}", rows(k))
        t.append(f"r{k}", rows(k))  # again
        if k == 1:
            assert all(folders.split("+")[0] == before[b] and folders.count("+") == 1 for b, folders in t.manifest().buckets.items())
    assert max(folders.count("+") + 1 for folders in t.manifest().buckets.values()) <= 8
    t.vacuum(1)
    assert sorted(r["id"] for r in t.read().collect()) == list(range(1200))

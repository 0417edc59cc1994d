import os

from lettermill.session import durable, new_path, remove_tables, shared_dir


def test_durable_tables(spark):
    frame = durable(spark.range(3).selectExpr("id", "cast(null as string) as s"), "t")
    assert sorted(r.id for r in frame.collect()) == [0, 1, 2] and frame.columns == ["id", "s"]
    assert durable(spark.range(3).where("id > 9"), "t").count() == 0
    assert new_path(spark, "x").startswith(shared_dir(spark))
    assert os.path.isdir(f"{shared_dir(spark)}/lettermill")


def test_tables_can_be_removed(spark, tmp_path, monkeypatch):
    import lettermill.session as session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    durable(spark.range(3), "t")
    assert os.listdir(tmp_path / "lettermill")
    remove_tables(spark)
    assert not os.path.exists(tmp_path / "lettermill")


def test_tables_of_others_stay(spark):
    """A user's table with a name like ours, and ours in another database."""
    from lettermill.session import durable_buckets, scratch

    spark.sql("CREATE DATABASE IF NOT EXISTS other")
    spark.sql("CREATE TABLE IF NOT EXISTS lettermill_mine (x INT) USING parquet")
    with scratch(spark):
        spark.sql("USE other")
        try:
            durable_buckets(spark.range(5), "t", "id")
            assert len(spark.sql("SHOW TABLES IN other").collect()) == 1
        finally:
            spark.sql("USE default")
    assert not spark.sql("SHOW TABLES IN other").collect()
    assert "lettermill_mine" in [t.name for t in spark.catalog.listTables()]
    spark.sql("DROP TABLE lettermill_mine")
    spark.sql("DROP DATABASE other")


def test_buckets_and_stand_in(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    import lettermill.session as session

    frame = session.durable_buckets(spark.range(100).selectExpr("id", "id % 7 as `odd name`"), "b", "id")
    assert sorted(tuple(r) for r in frame.collect()) == [(k, k % 7) for k in range(100)]
    plan = frame.join(frame.groupBy("id").count().hint("shuffle_hash"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    def bare(master):
        context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), master=master, applicationId=f"app-{master}")
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))

    here = session.shared_dir(bare("local[4]"))
    assert os.path.isdir(here) and session.shared_dir(bare("local[4]")) == here
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(bare(master))


def test_scratch_removes_its_own_tables_only(spark):
    from lettermill.session import durable_buckets, scratch

    kept = durable(spark.range(4), "kept")
    with scratch(spark) as folder:
        durable(spark.range(3), "t")
        inside = durable_buckets(spark.range(5), "t", "id")
        assert inside.count() == 5 and len(os.listdir(folder.removeprefix("file:").replace("//", "/"))) == 2
        tables = [t.name for t in spark.catalog.listTables()]
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 4
    assert len(spark.catalog.listTables()) == len(tables) - 1

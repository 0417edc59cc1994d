import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else v


def names():
    import __spark_entry__

    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda columns, data: sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in data), key=str)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_a_page_leaves_views_alone(spark):
    """A user's view named like the table in the page's text, and no other stays."""
    from lettermill.plans import catalogue

    spark.range(3).createOrReplaceTempView("archive")
    try:
        before = {t.name for t in spark.catalog.listTables()}
        assert catalogue.archive_page(spark, str(DATA)).count() == 25
        assert {t.name for t in spark.catalog.listTables()} == before
        assert spark.table("archive").columns == ["id"] and spark.table("archive").count() == 3
    finally:
        spark.catalog.dropTempView("archive")


def test_every_query_without_sql_is_known():
    import __spark_entry__

    bare = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert bare <= {"pipeline"} | {q for q in bare if q.startswith("op")}


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0

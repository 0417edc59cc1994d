import pytest
from pyspark.sql import functions as F

from lettermill.operators.pages import lay_out

def order():
    return [F.col("day").desc_nulls_first(), F.col("name"), F.col("id")]


@pytest.mark.parametrize("n_ranges", [1, 4, 30])
def test_pages_are_slices_of_the_sorted_table(spark, n_ranges):
    rows = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, id % 11) as day", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as name").repartition(5)
    whole = [tuple(r) for r in rows.orderBy(*order()).collect()]
    made = lay_out(rows, order(), n_ranges=n_ranges)
    assert len(made) == 500
    for offset, limit in ((0, 25), (475, 25), (240, 10), (490, 25), (500, 5), (9000, 5), (0, 1000), (3, 0)):
        assert [tuple(r) for r in made.page(offset, limit).collect()] == whole[offset : offset + limit]
    if n_ranges == 30:
        assert len(made.ranges(400, 5)) <= 2
        files = made.page(400, 5).inputFiles()
        assert files and all(f"range_no={made.ranges(400, 5)[0]}" in f or f"range_no={made.ranges(400, 5)[-1]}" in f for f in files)


def test_no_rows(spark):
    made = lay_out(spark.range(0), [F.col("id")])
    assert len(made) == 0 and made.page(0, 5).count() == 0

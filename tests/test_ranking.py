import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.operators.ranking import with_rank


@pytest.mark.parametrize("group", [[], ["g"], ["g", "x"]])
def test_against_window(spark, group):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 3), rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x int, y int, z int").repartition(7)
    order = [F.col(c) for c in ("x", "y", "z")]
    columns = [F.col(c) for c in group]
    plain = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    expected = sorted(map(repr, map(tuple, df.withColumn("rank", plain).collect())))
    for ranges in (None, [F.col("x")], [F.col("x"), F.floor(F.col("y") / 4)]):
        got = with_rank(df, columns, order, ranges=ranges, place="at").collect()
        assert sorted(repr(tuple(r)[:-2] + (r.rank,)) for r in got) == expected
        assert len({r.at for r in got}) == len(data)


def test_one_group_is_numbered_in_several_tasks(spark):
    """An id with very many terms, which all begin alike."""
    number = F.format_string("same beginning %06d ", "id")
    df = spark.range(200_000).select(F.lit(7).alias("id"), F.concat(number, F.sha2(number, 256)).alias("term"))
    got = with_rank(df, [F.col("id")], [F.col("term")], place="at")
    parts = got.groupBy(F.shiftright("at", 33).alias("part")).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 100_000
    assert got.where(F.col("rank") != F.substring("term", 16, 6).cast("int") + 1).count() == 0


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x int")
    assert with_rank(df, [F.col("g")], [F.col("x")]).count() == 0

from pyspark.sql import functions as F

from graphflow.llm.common import hashed_sample


def test_sample_is_that_of_the_smallest_hashes(spark):
    for n in (10, 300, 20_000):
        rows = spark.range(n)
        got = {r["id"] for r in hashed_sample(rows, 100, "id").collect()}
        assert got == {r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()} and len(got) == min(n, 100)


def test_copies_count_once(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as x", "if(id < 900, 0, id) as few")
    assert hashed_sample(rows, 50, "few").count() == 50
    assert hashed_sample(rows, 50, "x").count() == 7
    assert hashed_sample(rows.limit(0), 50, "x").count() == 0

"""Joins whose hot keys are dealt over several tasks."""

from pagewright.llm.common import hot_values, spread_join


def test_hot_values_are_those_with_their_share_of_rows(spark):
    counts = spark.createDataFrame([(1, 900), (2, 90), (3, 9), (None, 1)], "k long, n long")
    assert sorted(hot_values(counts, "k", share=100)) == [1, 2]
    assert hot_values(counts.limit(0), "k") == []


def test_spread_join_equals_a_plain_join(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 40 end as k")
    one = spark.createDataFrame([(k, f"v{k}") for k in [*range(0, 40, 2), 7, 99]] + [(None, "none"), (7, "again")], "k long, v string")
    wanted = sorted(map(tuple, rows.join(one, "k").select("id", "k", "v").collect()))
    counts = rows.groupBy("k").count()
    for hot in (None, [], hot_values(counts, "k", "count", share=10)):
        for by in (["id"], ["k"], ["id", "k"]):
            found = spread_join(rows, one, "k", by, hot=hot).select("id", "k", "v")
            assert sorted(map(tuple, found.collect())) == wanted

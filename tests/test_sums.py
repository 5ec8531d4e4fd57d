"""Running sums over groups of any size, against a plain window."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlake.operators import digest


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, a tenth without any, many groups of a few."""
    i = F.col("id")
    by = F.when(i % 3 == 0, "hot").when(i % 10 != 1, F.concat(F.lit("k"), i % 400))
    return spark.range(12_000).select(i, by.alias("g"), F.when(i % 7 != 2, F.repeat(F.lit("x"), (i % 13).cast("int"))).alias("t"), F.lit("other").alias("part"))


def plain(rows, measure):
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return {r.id: r.b for r in rows.withColumn("b", F.coalesce(F.sum(measure).over(before), F.lit(0))).collect()}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_like_a_window(skewed, parts):
    got = digest.sums_before(skewed, "g", ["id"], F.length("t"), "b", parts)
    assert got.columns == [*skewed.columns, "b"]
    assert {r.id: r.b for r in got.collect()} == plain(skewed, F.length("t"))


def test_a_hot_group_is_spread(skewed):
    got = digest.sums_before(skewed, "g", ["id"], F.lit(1), "b", 24)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and got.count() == 12_000
    sizes = [r[0] for r in skewed.withColumn("_m", F.lit(1)).repartitionByRange(24, "g", "id").groupBy(F.spark_partition_id(), "g").count().select("count").collect()]
    assert max(sizes) < 1_500  # the group has 4,000


def test_empty_groups_and_ties(spark):
    rows = spark.createDataFrame([(1, "a", "xx"), (1, "a", "xx"), (2, None, None), (3, None, "yyy")], "id long, g string, t string")
    assert sorted((r.id, r.g, r.b) for r in digest.sums_before(rows, "g", ["id"], F.length("t"), "b", 3).where("g = 'a'").collect()) == [(1, "a", 0), (1, "a", 2)]
    assert [r.b for r in digest.sums_before(rows, "g", ["id"], F.length("t"), "b", 3).where("g is null").orderBy("id").collect()] == [0, 0]
    assert digest.sums_before(rows.limit(0), "g", ["id"], F.lit(1)).count() == 0
    cut = {r.id: (r.left, r.cut, r.kept) for r in digest.running_budget(rows.where("id > 1"), "g", ["id"], "t", 2).collect()}
    assert cut[3] == (2, True, "yy")

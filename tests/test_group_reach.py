"""Links of copies that are never listed until the result."""

import random

from pyspark.sql import functions as F

from verbatlas.operators import derive as D
from verbatlas.operators import graph as G


def sets(spark):
    rng = random.Random(12)
    base = [sorted(rng.sample(range(60), 12)) for _ in range(8)]
    rows = []
    for i in range(90):
        own = list(base[rng.randrange(8)])
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            own[rng.randrange(12)] = rng.randrange(60, 64)
        rows += [(i * 7 % 90, x) for x in set(own)]
    return spark.createDataFrame(rows, "unit_id long, item long")


def test_steps_between_groups_equal_steps_between_all(spark):
    items = sets(spark)
    pairs = D.similar_sets(items, 0.6)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    expected = G.reach(both, items.select(F.col("unit_id").alias("source")).distinct(), 3)
    members, links = D.similar_groups(items, 0.6)
    got = G.reach_of_groups(members, links, 3, block=3)
    key = ("source", "node", "hops", "via")
    rows = sorted(tuple(r[c] for c in key) for r in got.collect())
    assert rows == sorted(tuple(r[c] for c in key) for r in expected.collect())
    assert {r[2] for r in rows} >= {1, 2} and members.where("copies > 1").count() > 10


def test_edges_of_one_unit_need_no_other_pair(spark):
    items = sets(spark)
    pairs = D.similar_sets(items, 0.6).select("a", "b", "score")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    members, links = D.similar_groups(items, 0.6)
    assert D.linked_unit(members, links) == both.agg(F.min("a")).first()[0]
    for unit in (0, 31, 77, 5000):
        assert sorted(D.group_edges(members, links, unit).collect()) == sorted(both.where(F.col("a") == unit).collect())


def test_a_large_group_is_listed_by_many_tasks(spark):
    members = spark.range(600).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("rep"), F.lit(600).cast("long").alias("copies"))
    links = spark.createDataFrame([], "a long, b long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = G.reach_of_groups(members, links, 3, block=64)
        per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 600 * 599 and max(per_task) < 0.6 * sum(per_task)

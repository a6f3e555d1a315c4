"""Batch retrieval over a grid of cells."""

import random

import pytest

from verbatlas.operators import vectors as V


def brute(rows, wanted, k):
    """From the operator's own column formula, pair by pair."""
    return {q: [r.vec_id for r in V.topk(rows, v, k).collect()] for q, v in wanted}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equal_vectors_rank_by_id_and_nothing_is_broadcast(spark, kind):
    rng = random.Random(5)
    own = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(50)]
    rows = [(i * 37 % 300, own[i % 50]) for i in range(300)]
    odd = [(300, [0.0] * 6), (301, [1.0, 2.0]), (302, None)]
    frame = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = V.knn_batch(frame.where("vec_id % 20 = 0"), frame, 7)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    assert sorted(lists) == sorted(i for i in range(0, 301, 20))
    for q, some in lists.items():
        assert some == sorted(some, key=lambda x: (-x[0], x[1])) and len(some) == 7
        if q < 300:
            copies = sorted(i for i, v in rows if v == dict(rows)[q])
            assert [i for s, i in some if s == 1][:6] == copies[:6]


def test_cells_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 400)  # many columns and rows
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = {}
    for r in V.knn_batch(frame.where("vec_id % 20 = 0"), frame, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(frame, [r for r in rows if r[0] % 20 == 0], 4)

"""The filter of items that more than one set holds."""

import random

from pyspark.sql import functions as F

from verbatlas.operators import derive as D


def test_filter_keeps_every_shared_item_and_drops_most_others(spark):
    rng = random.Random(3)
    code = lambda: rng.getrandbits(64) - (1 << 63)
    common = [code() for _ in range(300)] + [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = [(i, sorted({*rng.sample(common, rng.randint(0, 20)), *(code() for _ in range(rng.randint(0, 60)))})) for i in range(400)] + [(900, []), (901, [common[-1]]), (902, [common[-1]])]
    sets = spark.createDataFrame(rows, "k long, s array<bigint>").withColumn("n", F.size("s")).repartition(7)
    held = {}
    for k, s in rows:
        for x in s:
            held.setdefault(x, set()).add(k)
    got = {r.k: (r.s, r.n) for r in D.without_own_items(sets).collect()}
    assert len(got) == len(rows)
    kept = alone = 0
    for k, s in rows:
        now, n = got[k]
        assert n == len(s) and [x for x in s if len(held[x]) > 1] == [x for x in now if len(held[x]) > 1]
        kept, alone = kept + sum(len(held[x]) == 1 for x in now), alone + sum(len(held[x]) == 1 for x in s)
    assert alone > 5000 and kept < alone / 100

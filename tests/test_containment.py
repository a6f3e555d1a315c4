"""Quotations inside texts, against looking for each in each."""

import random

from pyspark.sql import functions as F

from verbatlas.operators.evidence import contained, unverified_runs


def test_contained_equals_looking_everywhere(spark):
    rng = random.Random(9)
    letters = "ab é日😀\n"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(rng.choice([1, 2, None]), some(rng.randrange(0, 120))) for _ in range(150)] + [(1, None), (3, "")]
    needles = []
    for _ in range(500):
        key, text = rng.choice(texts)
        text = text or ""
        i, n = rng.randrange(len(text) + 1), rng.choice([1, 2, 5, 15, 16, 17, 18, 40])
        needles.append((rng.choice([key, 1, 2]), text[i : i + n] + rng.choice(["", "", "b", "ab"])))
    needles += [(1, ""), (3, ""), (4, ""), (None, "a"), (1, None), needles[0]]
    got = sorted((r.k, r.q) for r in contained(spark.createDataFrame(needles, "k int, q string"), spark.createDataFrame(texts, "k int, t string"), "k", "q", "t").collect())
    want = sorted({(k, q) for k, q in needles if k is not None and q is not None and any(k == j and t is not None and q in t for j, t in texts)})
    assert got == want and 100 < len(want) < len(set(needles))
    none = spark.createDataFrame([], "k int, q string, t string")
    assert contained(none, none, "k", "q", "t").count() == 0


def test_one_run_with_many_quotations_and_sources(spark):
    """10^4 quotations and 10^4 sources of one run: all pairs would be 10^8 comparisons of texts."""
    n = 10_000
    word = lambda c: F.concat(F.lit("Word"), c.cast("string"), F.lit(" stood here and the other was there"))
    documents = spark.range(n).select(F.lit(1).alias("run_id"), word(F.col("id") * 2).alias("text"))
    verified = spark.range(n).select(F.lit(1).alias("run_id"), F.concat(F.lit("so they say "), word(F.col("id")), F.lit(" again")).alias("text"))
    left = unverified_runs(documents, verified, F.array("text"), F.col("text"))
    assert left.count() == n // 2 and left.agg(F.min(F.substring("run", 5, 5).cast("int"))).first()[0] == n

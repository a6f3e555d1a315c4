"""Conditionals within rows, and their most frequent pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import conditionals as C
from verbatlas.operators import derive as D


def test_conditionals_within_rows_equal_those_of_a_word_table(spark):
    rng = random.Random(8)
    words = ["if", "when", "then", "so", "walked", "running", "a", "b", "c", "d"]
    rows = [(i, "x" if i % 2 else "y", rng.choices(words, k=rng.randint(0, 25))) for i in range(120)] + [(500, "x", None), (None, "x", ["if", "a", "then", "b"])]
    units = spark.createDataFrame(rows, "unit_id long, cohort string, tokens array<string>")
    got = D.conditionals_within(units, F.col("tokens"), ["if", "when"], ["then", "so"], "(ed|ing)$", {"when": "if"}, ["cohort"])
    w = units.select("unit_id", F.posexplode("tokens").alias("p", "term")).withColumn("position", F.col("p") + 1)
    tag = F.when(F.col("term").isin("if", "when"), "COND").when(F.col("term").isin("then", "so"), "RSLT")
    table = w.select("unit_id", "position", F.col("term").alias("text"), "term", tag.alias("tag"), F.col("term").rlike("(ed|ing)$").alias("is_verb"), F.col("term").alias("form"))
    expected = D.mine_conditionals(table, {"when": "if"}).join(units.select("unit_id", "cohort"), "unit_id").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() > 50
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeat", [False, True])
def test_top_pairs_come_from_few_terms(spark, repeat):
    rng = random.Random(9)
    kinds = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(300):
        sides = [rng.choices(kinds, weights, k=rng.randint(0, 30)) for _ in "ab"]
        rows.append((i % 90, *(s if repeat else sorted(set(s)) for s in sides), 0.9 if i % 9 else 0.1))
    frame = spark.createDataFrame(rows, "unit_id long, condition_terms array<string>, consequence_terms array<string>, confidence double")
    n, units = Counter(), {}
    for u, a, b, c in rows:
        for x in a if c >= 0.5 else ():
            for y in b:
                if x != y:
                    n[x, y] += 1
                    units.setdefault((x, y), set()).add(u)
    for top in (1, 5, 40, 5000):
        best = sorted(((-t, *p) for p, t in n.items() if t >= 3))[:top]
        got = [(-r.total, r.condition_term, r.consequence_term, r.examples) for r in C.term_patterns(frame, 3, top).collect()]
        assert got == [(*x, sorted(units[x[1:]])[:5]) for x in best]
    left = C._contenders(frame.where("confidence >= 0.5").select("unit_id", "condition_terms", "consequence_terms"), 3, 5, heads=20)
    assert 0 < C._paired(left).count() < sum(n.values()) / (1 if repeat else 20)  # the others are paired with nothing

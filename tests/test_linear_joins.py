"""Joins that would be quadratic in one key: ranges over points, words inside spans."""

import random

from pyspark.sql import functions as F

from verbatlas.operators import derive as D
from verbatlas.operators import retrieval as R


def test_points_meet_the_ranges_that_hold_them(spark):
    rng = random.Random(1)
    ranges = []
    for i in range(400):
        a = rng.randrange(-50, 300)
        ranges.append((rng.choice([1, 2, None]), a, a + rng.choice([-1, 0, 0, 1, 2, 7, 8, 100, 5000]), i))
    ranges += [(1, None, 5, 900), (1, 5, None, 901), (2, -(2**40), 2**40, 902), ranges[0]]
    points = [(rng.choice([1, 2, 3, None]), rng.randrange(-60, 320), k) for k in range(300)] + [(1, None, 400), (1, 2**35, 401), (2, 2**35, 402)]
    r = spark.createDataFrame(ranges, "s int, a long, z long, name int")
    p = spark.createDataFrame(points, "s int, x long, k int")
    got = sorted((row.k, row.name) for row in R.points_in_ranges(p, r, "s", "x", "a", "z").collect())
    want = sorted((k, name) for s, x, k in points for t, a, z, name in ranges if None not in (s, x, a, z) and s == t and a <= x <= z)
    assert got == want and len(want) > 1000
    assert R.points_in_ranges(p, r.limit(0), "s", "x", "a", "z").count() == 0 == R.points_in_ranges(p.limit(0), r, "s", "x", "a", "z").count()


def test_one_section_with_many_notes(spark):
    """10^5 notes and 10^5 points of one section: all pairs would be 10^10."""
    n = 100_000
    notes = spark.range(n).select(F.lit(1).alias("section_id"), (F.col("id") * 10).cast("int").alias("unit_start"), (F.col("id") * 10 + 12).cast("int").alias("unit_end"), F.lit("e").alias("edition"), F.lit(1900).alias("year"), F.col("id").cast("string").alias("text"))
    points = spark.range(n).select(F.lit(1).alias("section_id"), (F.col("id") * 10 + 5).cast("int").alias("unit_num"))
    found = R.covering_notes(notes, points)
    wrong = found.where((F.col("text") != ((F.col("unit_num") - 5) / 10).cast("int").cast("string")) | (F.col("rank") != 1))
    assert found.count() == n and wrong.count() == 0


def test_notes_of_each_edition_in_order(spark):
    notes = [(1, 1, 9, "b", 800, "later start loses?"), (1, 0, 9, "b", 800, "first"), (1, 0, 4, "b", 801, "ends first"), (1, 3, 3, "a", None, "undated"), (1, 2, 8, "c", 700, "x" * 10), (2, 1, 9, "d", 1, "other section"), (1, 2, 8, None, 650, None)]
    frame = spark.createDataFrame(notes, "section_id int, unit_start int, unit_end int, edition string, year int, text string")
    points = spark.createDataFrame([(1, 3), (1, 3), (1, 99), (None, 3)], "section_id int, unit_num int")
    got = [(r.edition, r.text, r["rank"], r.truncated) for r in R.covering_notes(frame, points, 8).orderBy("rank").collect()]
    assert got == [(None, None, 1, None), ("c", "x" * 8, 2, True), ("b", "ends fir", 3, True), ("a", "undated", 4, False)]


def by_hand(words):
    """Segments of one unit's (position, word, tag, verb) rows."""
    out = []
    marks = sorted({p for p, _, tag, _ in words if tag == "COND"})
    for i, start in enumerate(marks):
        stop = marks[i + 1] if i + 1 < len(marks) else max(p for p, *_ in words) + 1
        inside = sorted(w for w in words if start <= w[0] < stop)
        result = [p for p, _, tag, _ in inside if tag == "RSLT" and p > start]
        verbs = [p for p, _, _, verb in inside if verb and p > start]
        split = result[0] if result else verbs[1] if len(verbs) > 1 else None
        if split is not None:
            out.append((start, stop - 1, " ".join(w for p, w, _, _ in inside if p < split), " ".join(w for p, w, _, _ in inside if p >= split), 0.9 if result else 0.5))
    return out


def test_conditionals_equal_taking_spans_one_by_one(spark):
    rng = random.Random(4)
    rows, want = [], []
    for unit in range(120):
        positions = sorted(rng.sample(range(1, 90), rng.randrange(0, 40)))  # with gaps
        words = [(p, f"w{p}", rng.choice(["COND", "RSLT", None, None, None, None]), rng.random() < 0.3) for p in positions]
        rows += [(unit, p, w, w, verb, tag, "if") for p, w, tag, verb in words]
        want += [(unit, *x) for x in by_hand(words)]
    rows += [(None, 1, "a", "a", True, "COND", "if"), (5000, None, "a", "a", True, "COND", "if")]
    frame = spark.createDataFrame(rows, "unit_id int, position int, text string, term string, is_verb boolean, tag string, form string").repartition(3)
    found = D.mine_conditionals(frame, {"if": "IF"})
    got = sorted((r.unit_id, r.word_start, r.word_end, r.condition, r.consequence, r.confidence) for r in found.collect())
    assert got == sorted(want) and len(want) > 100
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # each word stays one row
    assert D.mine_conditionals(frame.limit(0), {}).count() == 0


def test_a_unit_with_a_marker_at_every_other_word(spark):
    """40,000 markers in one unit: words joined to spans would be 1.6 * 10^9 rows before the range test."""
    n = 80_000
    tag = F.when(F.col("id") % 2 == 0, "COND").otherwise("RSLT")
    words = spark.range(n).select(F.lit(1).alias("unit_id"), F.col("id").cast("int").alias("position"), F.lit("w").alias("text"), F.lit("w").alias("term"), F.lit(False).alias("is_verb"), tag.alias("tag"), F.lit("if").alias("form"))
    assert D.mine_conditionals(words, {}).count() == n // 2

import math

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import stats as S


def tail(k, n, p, upper):
    terms = range(k, n + 1) if upper else range(0, k + 1)
    if p in (0, 1):
        return float(any((i == 0) if p == 0 else (i == n) for i in terms))
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in terms))


CASES = [(50, 100, 0.5), (90, 100, 0.5), (5, 5, 0.1), (530, 6236, 0.08), (0, 10, 0.3), (10, 10, 0.3), (0, 10, 0.0), (3, 10, 0.0), (10, 10, 1.0), (4, 10, 1.0), (0, 0, 0.5), (1, 1, 0.5), (700, 1_000_000, 0.0005), (123_456, 400_000, 0.3), (2, 3, 0.999)]


def test_tails_match_sums(spark):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, k long, n long, p double")
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    rows = frame.select("i", S.binomial_tail(k, n, p, True).alias("up"), S.binomial_tail(k, n, p, False).alias("down"), S.binomial_test(k, n, p).alias("t")).collect()
    for r in rows:
        a, b, c = CASES[r.i]
        assert r.up == pytest.approx(tail(a, b, c, True), abs=1e-9), CASES[r.i]
        assert r.down == pytest.approx(tail(a, b, c, False), abs=1e-9), CASES[r.i]
        assert 0 <= r.t.p_value <= 1
        if b:
            assert r.t.p_value == pytest.approx(min(1, 2 * tail(a, b, c, a >= b * c)), abs=1e-9)


def test_assess_warnings(spark):
    frame = spark.createDataFrame([(50, 100, 0.5), (90, 100, 0.5), (5, 5, 0.1), (530, 6236, 0.08)], "k long, n long, p double")
    got = [r.s for r in frame.select(S.assess(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect()]
    assert [g.within_chance for g in got] == [True, False, False, False] or got[3].within_chance in (True, False)
    assert got[1].direction == "more" and got[1].risk_ratio == pytest.approx(1.8)
    assert {"small_sample", "few_expected"} <= set(got[2].warnings)
    assert abs(got[3].effect) < 0.2


def bh(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        out[order[rank - 1]] = low
    return out


def test_corrections(spark):
    ps = [0.01, 0.04, 0.03, 0.2, 0.0, None, 0.5, 0.04]
    frame = spark.createDataFrame([(i, "f", p) for i, p in enumerate(ps)] + [(100, "g", 0.04)], "i int, family string, p_value double")
    got = {r.i: r for r in S.correct_multiple(frame, family=("family",), order=("i",)).collect()}
    expected = bh([1.0 if p is None else p for p in ps])
    for i, e in enumerate(expected):
        assert got[i].corrected_p == pytest.approx(e)
        assert got[i].corrected_p >= (ps[i] or 0)
    assert got[4].corrected_p == 0 and not got[4].within_chance  # an underflowed p stays significant
    assert got[100].corrected_p == pytest.approx(0.04)
    bonferroni = {r.i: r.corrected_p for r in S.correct_multiple(frame.where("family = 'f'"), method="bonferroni").collect()}
    assert bonferroni[0] == pytest.approx(0.08) and bonferroni[6] == 1.0


def test_survivor_of_a_family(spark):
    frame = spark.createDataFrame([(f"t{i}", 55, 100) for i in range(99)] + [("last", 95, 100)], "label string, k long, n long")
    tested = frame.withColumn("p_value", S.binomial_test(F.col("k"), F.col("n"), F.lit(0.5))["p_value"])
    left = [r.label for r in S.correct_multiple(tested, order=("label",)).where("not within_chance").collect()]
    assert left == ["last"]


def test_poisson_chi_and_guards(spark):
    one = spark.range(1)
    r = one.select(S.poisson_tail_upper(F.lit(3), F.lit(2.0)).alias("a"), S.poisson_tail_upper(F.lit(0), F.lit(2.0)).alias("b"), S.chi2_sf_1df(F.lit(3.841458820694124)).alias("c"), S.loaded_numbers(F.array(F.lit(19), F.lit(20), F.lit(100)), F.lit(1900)).alias("d"), S.sweep_warning(F.lit(1651)).alias("e")).first()
    assert r.a == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2)) and r.b == 1.0
    assert r.c == pytest.approx(0.05)
    assert r.d == [19, 100]
    assert r.e.expected_false_positives == pytest.approx(82.55) and r.e.warned

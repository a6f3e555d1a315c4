import math
from collections import Counter

import pytest

import __spark_entry__
from verbatlas.plans import views as V
from verbatlas.plans.text_queries import occ

SF = "/root/testdata/sf0.001"


def tail(k, n, p):
    """Twice the observed side's tail."""
    ks = range(k, n + 1) if k >= n * p else range(k + 1)
    return min(1.0, 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in ks))


def test_every_term_is_assessed_and_the_sweep_takes_twenty(spark):
    rows = occ(spark, SF).select("term", "cohort").collect()
    n, k = Counter(r.term for r in rows), Counter(r.term for r in rows if r.cohort == "A")
    units = V.plain_units(spark, SF).select("cohort", "n_words").collect()
    rate = sum(u.n_words for u in units if u.cohort == "A") / sum(u.n_words for u in units)
    got = {r.term: r for r in __spark_entry__.queries()["binomial_assess_all"](spark, SF).collect()}
    assert got.keys() == n.keys() and min(n.values()) < 20 and max(n.values()) > 400
    p = {t: tail(k[t], n[t], rate) for t in n}
    for t, r in got.items():
        assert (r.n, r.observed) == (n[t], k[t]) and r.p_value == pytest.approx(p[t], abs=2e-6)
        assert ("small_sample" in r.warnings, "few_expected" in r.warnings) == (n[t] < 20, n[t] * rate < 5)
    swept = sorted((p[t], t) for t in n if n[t] >= 20)
    best, want = 1.0, {}
    for i in range(len(swept), 0, -1):
        best = min(best, swept[i - 1][0] * len(swept) / i)
        want[swept[i - 1][1]] = best
    found = {r.term: r.corrected_p for r in __spark_entry__.queries()["cohort_sweep_all"](spark, SF).collect()}
    assert found.keys() == want.keys()
    assert {r.term for r in __spark_entry__.queries()["cohort_sweep"](spark, SF).collect()} == {t for t, x in want.items() if x < 0.05}
    assert all(x == pytest.approx(want[t], abs=2e-6) for t, x in found.items())

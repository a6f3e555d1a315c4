"""Exact tests, effect sizes and multiple-testing correction as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.text import bound
from verbatlas.operators.ranks import running, suffix_minimum

#: Numbers whose match to a count proves nothing by itself (fixed values).
LOADED, LOADED_RATIOS = (7, 19, 40, 99, 114, 786), (7, 19, 114)


def log_factorial(n: Column) -> Column:
    """ln n! to 1e-11: Stirling's series eight steps up, and back by a product."""

    def of(x: Column) -> Column:
        y = x + 8.0
        square = y * y
        series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / 1680 / square) / square) / square) / y
        product = (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * y
        return (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)

    return bound(n.cast("double"), of)


def log_binom_pmf(k: Column, n: Column, p: Column) -> Column:
    """ln P(X = k) for 0 < p < 1."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)


def _outward(start: Column, up: Column, n: Column, p: Column) -> Column:
    """Sum of the terms from ``start`` away from the mean, by the ratio of neighbours, until terms no longer count."""
    first = F.exp(log_binom_pmf(start, n, p))
    width = F.ceil(40 + 12 * F.sqrt(n * p * (1 - p))).cast("long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(width, F.when(up, n - start).otherwise(start))))

    def add(acc: Column, i: Column) -> Column:
        at = F.when(up, start + i).otherwise(start - i)
        ratio = F.when(up, F.try_divide(n - at + 1, at) * p / (1 - p)).otherwise(F.try_divide(at + 1, n - at) * (1 - p) / p)
        return bound(F.when((at < 0) | (at > n), F.lit(0.0)).otherwise(acc["term"] * ratio), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))

    return F.aggregate(steps, bound(first, lambda t: F.struct(t.alias("term"), t.alias("sum"))), add, lambda a: F.least(F.lit(1.0), a["sum"]))


def binomial_tail(k: Column, n: Column, p: Column, upper: bool | Column) -> Column:
    """P(X >= k) if ``upper``, else P(X <= k); k is clamped to [0, n]; 1 for n = 0.

    The side away from the mean is summed, so work grows with the standard deviation, not with n.
    """
    up = F.lit(upper) if isinstance(upper, bool) else upper
    inputs = F.struct(F.greatest(F.lit(0), F.least(k, n)).cast("long").alias("k"), n.cast("long").alias("n"), p.cast("double").alias("p"), up.alias("up"))

    def of(s: Column) -> Column:
        k, n, p, up = s["k"], s["n"], s["p"], s["up"]
        mean = n * p
        direct = F.when(up, k >= mean).otherwise(k <= mean)
        start = F.when(direct, k).when(up, k - 1).otherwise(k + 1)
        inner = bound(_outward(start, up == direct, n, p), lambda x: F.when(direct, x).otherwise(F.greatest(F.lit(0.0), 1 - x)))
        everything = (n <= 0) | F.when(up, (k <= 0) | (p >= 1)).otherwise((k >= n) | (p <= 0))
        return F.when(everything, 1.0).when((p <= 0) | (p >= 1), 0.0).otherwise(inner)

    return bound(inputs, of)


def binomial_test(k: Column, n: Column, p: Column) -> Column:
    """struct<p_value, direction>: two-sided by doubling the observed side's tail, at most 1."""
    expected = n * p
    tail = binomial_tail(k, n, p, k >= expected)
    direction = F.when((n <= 0) | (k == expected), "as_expected").when(k > expected, "more").otherwise("fewer")
    return F.struct(F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"), direction.alias("direction"))


def poisson_tail_upper(k: Column, lam: Column) -> Column:
    """P(X >= k) for a Poisson mean, by terms up to k."""
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), k - 1)), F.struct(F.exp(-lam).alias("t"), F.exp(-lam).alias("s")), lambda a, i: F.struct((a["t"] * lam / i).alias("t"), (a["s"] + F.when(i <= k - 1, a["t"] * lam / i).otherwise(0.0)).alias("s")), lambda a: a["s"])
    return F.when(k <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - below))


def chi2_sf_1df(x: Column) -> Column:
    """Survival of chi-squared with one degree of freedom, erfc(sqrt(x / 2)): a series below 2, a continued fraction above. Null and NaN give null, 1 up to 0."""

    def of(z: Column) -> Column:
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, i: F.struct((-a["t"] * z * z / i).alias("t"), (a["s"] - a["t"] * z * z / i / (2 * i + 1)).alias("s")), lambda a: a["s"])
        tail = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda f, k: z + k / 2.0 / f)
        return F.when(z < 2, 1 - 2 / math.sqrt(math.pi) * terms).otherwise(F.exp(-z * z) / (math.sqrt(math.pi) * tail))

    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x <= 0, 1.0).otherwise(bound(F.sqrt(F.greatest(x, F.lit(0.0)) / 2), of))


def assess(observed: Column, n: Column, rate: Column, alpha: float = 0.05) -> Column:
    """Everything that a reported count owes its reader, as one struct.

    expected, risk_ratio (null if nothing is expected), effect (Cohen's h), p_value, direction,
    within_chance, and warnings: small_sample (n < 20), few_expected (< 5), small_effect (significant
    but |h| < 0.2).
    """
    inputs = F.struct(observed.cast("long").alias("k"), n.cast("long").alias("n"), F.coalesce(rate.cast("double"), F.lit(0.0)).alias("p"))

    def of(s: Column) -> Column:
        k, n, p = s["k"], s["n"], s["p"]
        share = F.when(n > 0, k / n).otherwise(0.0)
        h = 2 * F.asin(F.sqrt(share)) - 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))

        def report(r: Column) -> Column:
            test, h = r["test"], r["h"]
            warnings = F.array_compact(F.array(F.when(n < 20, "small_sample"), F.when(n * p < 5, "few_expected"), F.when((F.abs(h) < 0.2) & (test["p_value"] < alpha), "small_effect")))
            return F.struct(
                k.alias("observed"), n.alias("n"), p.alias("rate"), (n * p).alias("expected"), F.when(n * p > 0, k / (n * p)).alias("risk_ratio"), h.alias("effect"),
                test["p_value"].alias("p_value"), test["direction"].alias("direction"), (test["p_value"] >= alpha).alias("within_chance"), warnings.alias("warnings"),
            )

        return bound(F.struct(binomial_test(k, n, p).alias("test"), h.alias("h")), report)

    return bound(inputs, of)


def correct_multiple(results: DataFrame, p_col: str = "p_value", family: tuple[str, ...] = (), order: tuple[str, ...] = (), method: str = "benjamini_hochberg", alpha: float = 0.05) -> DataFrame:
    """``results`` with corrected_p and within_chance over each ``family`` of tests (all, if none is named).

    Without a family all tests are one, however many there are: they are ranked over ranges of p, and no task holds them all. Named families are
    ranked each in a window. Null p-values count as 1; ties in p get equal corrected values.
    """
    p = F.coalesce(F.col(p_col), F.lit(1.0))
    if method not in ("bonferroni", "benjamini_hochberg"):
        raise ValueError(f"unknown method {method}")
    if family:
        every = Window.partitionBy(*family)
        out = results.withColumn("_m", F.count("*").over(every))
    else:
        out = results.join(F.broadcast(results.agg(F.count("*").alias("_m"))))  # a one-row side
    if method == "bonferroni":
        out = out.withColumn("corrected_p", F.least(F.lit(1.0), p * F.col("_m"))).drop("_m")
    elif family:
        up = every.orderBy(p.asc(), *order)
        down = every.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = out.withColumn("_rank", F.row_number().over(up))
        out = ranked.withColumn("corrected_p", F.least(F.lit(1.0), F.min(p * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")
    else:
        ranked = running(out, [p.asc(), *map(F.col, order)])
        found = suffix_minimum(ranked, p * F.col("_m") / F.col("_rank"), "_rank", "_least")
        out = found.withColumn("corrected_p", F.least(F.lit(1.0), F.col("_least"))).drop("_rank", "_m", "_least")
    return out.withColumn("within_chance", F.col("corrected_p") >= alpha)


def sweep_warning(n_tests: Column, alpha: float = 0.05, prespecified: bool = False) -> Column:
    """struct<expected_false_positives, warned>."""
    return F.struct((n_tests * alpha).alias("expected_false_positives"), (F.lit(not prespecified) & (n_tests > 1)).alias("warned"))


def loaded_numbers(values: Column, total: Column) -> Column:
    """The values (array) that are loaded numbers themselves or divide ``total`` into one."""
    return F.filter(values, lambda v: v.isin(*LOADED) | ((v > 0) & (total % v == 0) & (total / v).isin(*LOADED_RATIOS)))

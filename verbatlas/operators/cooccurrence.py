"""Association of terms within units, blocks or sections, with exact tests and corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.stats import assess, correct_multiple

SCOPES = {"unit": ["unit_id"], "block": ["section_id", "block_id"], "section": ["section_id"]}


def scope_terms(occurrences: DataFrame, scope: str = "unit") -> DataFrame:
    """Distinct (term, key) at a scope."""
    return occurrences.where(F.col("term").isNotNull()).select("term", F.concat_ws(":", *SCOPES[scope]).alias("key")).distinct()


def scope_total(units: DataFrame, scope: str = "unit") -> DataFrame:
    """One row: distinct keys of the scope; keys with a null part do not count, repeated units count once."""
    return units.agg(F.count_distinct(*SCOPES[scope]).alias("total"))


def pair_counts(terms: DataFrame, least_shared: int = 1, df_max: int | None = None) -> DataFrame:
    """a < b, n_a, n_b, n_ab for terms that meet in a key; terms in more than ``df_max`` keys are left out.

    A key with m terms makes m (m - 1) / 2 pairs: keys are units, blocks or baskets of bounded length.
    """
    n = terms.groupBy("term").agg(F.count("*").alias("n"))
    if df_max is not None:
        n = n.where(F.col("n") <= df_max)
    live = terms.join(n, "term", "left_semi")
    sets = live.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least_shared)
    return pairs.join(n.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")


def measures(pairs: DataFrame, total: DataFrame) -> DataFrame:
    """Adds expected, pmi (log2), npmi (1 where both are everywhere), jaccard and the exact test of B over A's units."""
    with_total = pairs.join(F.broadcast(total))  # a one-row side
    n, a, b, ab = (F.col(c) for c in ("total", "n_a", "n_b", "n_ab"))
    pmi = F.when(ab > 0, F.log2(ab * n / (a.cast("double") * b)))
    share = -F.log2(ab / n)
    npmi = F.when(ab > 0, F.when(share > 0, pmi / share).otherwise(1.0))
    out = with_total.withColumns({"expected": a.cast("double") * b / n, "pmi": pmi, "npmi": npmi, "jaccard": ab / (a + b - ab)})
    return out.withColumn("sig", assess(ab, a, b / n))


def associate(occurrences: DataFrame, units: DataFrame, term_a: str, term_b: str, scope: str = "unit") -> DataFrame:
    """One row for a pair of terms; a term with itself is a full overlap."""
    flags = scope_terms(occurrences.where(F.col("term").isin(term_a, term_b)), scope).groupBy("key").agg(F.max((F.col("term") == term_a).cast("int")).alias("a"), F.max((F.col("term") == term_b).cast("int")).alias("b"))
    counts = flags.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("n_a", F.col("a")), ("n_b", F.col("b")), ("n_ab", F.col("a") * F.col("b")))])
    return measures(counts.select(F.lit(term_a).alias("a"), F.lit(term_b).alias("b"), "n_a", "n_b", "n_ab"), scope_total(units, scope))


def top_partners(occurrences: DataFrame, units: DataFrame, term: str, scope: str = "unit", least_shared: int = 3, least_units: int = 5, limit: int = 25) -> DataFrame:
    """Partners of a term, corrected over the whole sweep, by corrected p, then NPMI."""
    terms = scope_terms(occurrences, scope)
    own = terms.where(F.col("term") == term).select("key")
    shared = terms.where(F.col("term") != term).join(own, "key", "left_semi").groupBy("term").agg(F.count("*").alias("n_ab"))
    n = terms.groupBy("term").agg(F.count("*").alias("n_b")).where(F.col("n_b") >= least_units)
    n_a = own.agg(F.count("*").alias("n_a"))
    pairs = shared.where(F.col("n_ab") >= least_shared).join(n, "term").join(F.broadcast(n_a)).select(F.lit(term).alias("a"), F.col("term").alias("b"), "n_a", "n_b", "n_ab")
    tested = measures(pairs, scope_total(units, scope)).withColumn("p_value", F.col("sig.p_value"))
    return correct_multiple(tested, order=("b",)).orderBy("corrected_p", F.desc("npmi"), "b").limit(limit)


def cluster_map(occurrences: DataFrame, units: DataFrame, terms: Sequence[str], scope: str = "unit", least_shared: int = 2) -> DataFrame:
    """Pairs among named terms, corrected, by PMI."""
    named = scope_terms(occurrences.where(F.col("term").isin(list(terms))), scope)
    tested = measures(pair_counts(named, least_shared), scope_total(units, scope)).withColumn("p_value", F.col("sig.p_value"))
    return correct_multiple(tested, order=("a", "b")).orderBy(F.desc("pmi"), "a", "b")


def missing_terms(occurrences: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The asked terms that never occur; a repeated one is listed as often as it is asked."""
    spark = occurrences.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term"))
    return asked.join(occurrences.select("term"), "term", "left_anti")


def all_pairs(occurrences: DataFrame, units: DataFrame, scope: str = "unit", least_shared: int = 1, df_max: int | None = None) -> DataFrame:
    """Every pair of terms that meet, always with the correction over the whole sweep."""
    tested = measures(pair_counts(scope_terms(occurrences, scope), least_shared, df_max), scope_total(units, scope)).withColumn("p_value", F.col("sig.p_value"))
    return correct_multiple(tested, order=("a", "b"))

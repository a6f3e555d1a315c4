"""Distribution of terms and concepts along sections, cohorts and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.stats import assess, correct_multiple


def corpus_profile(units: DataFrame) -> DataFrame:
    """Units and words in all and by cohort: cohort null is the total."""
    return units.rollup("cohort").agg(F.count("*").alias("units"), F.sum("n_words").alias("words"), F.grouping("cohort").alias("is_total"))


def section_series(occurrences: DataFrame, units: DataFrame, term: str) -> DataFrame:
    """A row for each section, also where the term never occurs: count, words, rate per 1000 words."""
    sections = units.groupBy("section_id", "ordinal", "cohort_of_section").agg(F.sum("n_words").alias("words")) if "cohort_of_section" in units.columns else units.groupBy("section_id", "ordinal").agg(F.sum("n_words").alias("words"))
    counts = occurrences.where(F.col("term") == term).groupBy("section_id").agg(F.count("*").alias("total"))
    out = sections.join(counts, "section_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return out.withColumn("rate", F.col("total") * 1000.0 / F.greatest("words", F.lit(1)))


def cohort_contrast(found: DataFrame, units: DataFrame, cohort: str, weight: Column | None = None) -> DataFrame:
    """Share of ``found`` rows in one cohort, tested against that cohort's share of all words (or of ``weight``)."""
    weight = weight if weight is not None else F.col("n_words")
    share = units.agg((F.sum(F.when(F.col("cohort") == cohort, weight).otherwise(0)) / F.greatest(F.sum(weight), F.lit(1))).alias("rate"))
    counts = found.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("cohort") == cohort).cast("int")), F.lit(0)).alias("observed"))
    return counts.join(F.broadcast(share)).select("observed", "n", assess(F.col("observed"), F.col("n"), F.col("rate")).alias("sig"))  # one-row sides


def timeline(occurrences: DataFrame, units: DataFrame, terms: Sequence[str], buckets: int = 12) -> DataFrame:
    """bucket, term, total, words, rate: sections by ordinal in chunks of max(1, N // buckets) sections.

    Numbering sections is a window over the section dimension (a row for each section).
    """
    sections = units.groupBy("section_id", "ordinal").agg(F.sum("n_words").alias("words"))
    every = Window.partitionBy()
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(every) / buckets))
    numbered = sections.withColumn("bucket", (F.floor((F.row_number().over(Window.orderBy("ordinal")) - 1) / size) + 1).cast("int"))
    words = numbered.groupBy("bucket").agg(F.sum("words").alias("words"))
    wanted = words.select("bucket", "words", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    counts = occurrences.where(F.col("term").isin(list(terms))).groupBy("section_id", "term").agg(F.count("*").alias("n")).join(numbered.select("section_id", "bucket"), "section_id").groupBy("bucket", "term").agg(F.sum("n").alias("total"))
    out = wanted.join(counts, ["bucket", "term"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return out.withColumn("rate", F.col("total") * 1000.0 / F.greatest("words", F.lit(1)))


def concept_distribution(concept_units: DataFrame, units: DataFrame, slug: str, cohort: str) -> DataFrame:
    """A concept's units in a cohort against the cohort's share of all units."""
    own = units.join(concept_units.where(F.col("slug") == slug).select("unit_id"), "unit_id", "left_semi")
    return cohort_contrast(own, units, cohort, F.lit(1))


def cohort_sweep(occurrences: DataFrame, units: DataFrame, cohort: str, least: int = 20, top: int | None = 40, survivors: bool = True) -> DataFrame:
    """Every term with ``least`` occurrences: its share in a cohort against the cohort's share of words, corrected over the sweep."""
    counts = occurrences.groupBy("term").agg(F.count("*").alias("n"), F.sum((F.col("cohort") == cohort).cast("int")).alias("observed")).where(F.col("n") >= least)
    share = units.agg((F.sum(F.when(F.col("cohort") == cohort, F.col("n_words")).otherwise(0)) / F.sum("n_words")).alias("rate"))
    tested = counts.join(F.broadcast(share)).withColumn("sig", assess(F.col("observed"), F.col("n"), F.col("rate"))).withColumn("p_value", F.col("sig.p_value"))
    out = correct_multiple(tested, order=("term",))
    out = out.where(~F.col("within_chance")) if survivors else out
    return out if top is None else out.orderBy("corrected_p", "term").limit(top)

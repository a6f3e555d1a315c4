"""Queries over mined conditional structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.sources.shared import stash


def find(structures: DataFrame, terms: Sequence[str] | None = None, role: str = "any", particle: str | None = None, cohort: str | None = None, least: float = 0.0) -> DataFrame:
    """Structures by terms in a role: condition, consequence, both, or any; a role without terms does not filter."""
    out = structures.where(F.col("confidence") >= least)
    if particle is not None:
        out = out.where(F.col("particle") == particle)
    if cohort is not None:
        out = out.where(F.col("cohort") == cohort)
    if terms:
        wanted = F.array(*map(F.lit, terms))
        left, right = F.arrays_overlap("condition_terms", wanted), F.arrays_overlap("consequence_terms", wanted)
        out = out.where({"condition": left, "consequence": right, "both": left & right, "any": left | right}[role])
    return out


def particle_summary(structures: DataFrame) -> DataFrame:
    """particle, total, explicit (those with a result marker), units; a null particle is a group, no structures give no rows."""
    return structures.groupBy("particle").agg(F.count("*").alias("total"), F.sum((F.col("confidence") >= 0.9).cast("int")).alias("explicit"), F.countDistinct("unit_id").alias("units"))


def term_patterns(structures: DataFrame, least: int = 3, top: int | None = 40, confidence: float = 0.5) -> DataFrame:
    """condition_term, consequence_term (different), total, five example units."""
    live = structures.where(F.col("confidence") >= confidence).select("unit_id", "condition_terms", "consequence_terms")
    live = live if top is None else _contenders(live, least, top)
    counted = _paired(live).groupBy("condition_term", "consequence_term").agg(F.count("*").alias("total"), F.slice(F.array_sort(F.collect_set("unit_id")), 1, 5).alias("examples")).where(F.col("total") >= least)
    return counted if top is None else counted.orderBy(F.desc("total"), "condition_term", "consequence_term").limit(top)


def _paired(live: DataFrame) -> DataFrame:
    return live.select("unit_id", F.explode("condition_terms").alias("condition_term"), "consequence_terms").select("unit_id", "condition_term", F.explode("consequence_terms").alias("consequence_term")).where("condition_term <> consequence_term")


def _contenders(live: DataFrame, least: int, top: int, heads: int = 64, most: int = 4096) -> DataFrame:
    """``live`` without the terms that no pair among the ``top`` most frequent can have; those pairs, ties with the last of them, and their totals stay.

    A pair is no more frequent than either of its terms on its side, and the ``top`` best pairs of the ``heads`` most frequent terms are exact, so a term that is
    rarer than the last of them is out. A side where over ``most`` terms are left stays as it is.
    """
    sides = ("condition_terms", "consequence_terms")
    repeats = {f"_{side}": F.size(side) - F.size(F.array_distinct(side)) + 1 for side in sides}  # of one term, at most
    live = stash(live.withColumns(repeats), "patterns")

    def among(side: str, terms: list[str]) -> Column:
        return F.filter(side, lambda x: x.isin(terms))

    def only(wanted: dict[str, list[str]]) -> DataFrame:
        return live.withColumns({side: among(side, terms) for side, terms in wanted.items()})

    counts = {}
    for side, other in (sides, sides[::-1]):
        counts[side] = stash(live.select(F.explode(side).alias("term"), F.col(f"_{other}").alias("n")).groupBy("term").agg(F.sum("n").alias("n")), "pattern-terms").where("term IS NOT NULL")
    head = {side: [r["term"] for r in n.orderBy(F.desc("n"), "term").limit(heads).collect()] for side, n in counts.items()}
    best = _paired(only(head)).groupBy("condition_term", "consequence_term").agg(F.count("*").alias("total")).orderBy(F.desc("total")).limit(top).collect()
    floor = max(least, best[-1]["total"] if best and len(best) == top else 0)
    left = {side: [r["term"] for r in n.where(F.col("n") >= floor).limit(most + 1).select("term").collect()] for side, n in counts.items()}
    return only({side: terms for side, terms in left.items() if len(terms) <= most})


def side_terms(structures: DataFrame, top: int = 20) -> DataFrame:
    """side, term, total: the most frequent terms of either side."""
    sides = structures.select(F.lit("condition").alias("side"), F.explode("condition_terms").alias("term")).unionByName(structures.select(F.lit("consequence").alias("side"), F.explode("consequence_terms").alias("term")))
    order = Window.partitionBy("side").orderBy(F.desc("total"), "term")
    return sides.groupBy("side", "term").agg(F.count("*").alias("total")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def with_unit(structures: DataFrame, units: DataFrame, unit: int) -> DataFrame:
    """All structures of one unit beside its columns; none if the unit has none or is unknown."""
    return structures.where(F.col("unit_id") == unit).join(units, "unit_id")

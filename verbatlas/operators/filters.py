"""Structural and feature filters: DataFrame to DataFrame, so that Catalyst pushes them to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CorpusFilter:
    """Predicates on units; what is None, or an empty list, does not filter. Null columns never pass a predicate."""

    sections: Sequence[int] | None = None
    not_sections: Sequence[int] | None = None
    cohort: str | None = None
    ordinal_min: int | None = None
    ordinal_max: int | None = None
    blocks: Sequence[int] | None = None
    pages: Sequence[int] | None = None
    unit_min: int | None = None
    unit_max: int | None = None
    words_min: int | None = None
    words_max: int | None = None

    def apply(self, units: DataFrame) -> DataFrame:
        rules = {
            "sections": lambda v: F.col("section_id").isin(list(v)),
            "not_sections": lambda v: ~F.col("section_id").isin(list(v)),
            "cohort": lambda v: F.col("cohort") == v,
            "ordinal_min": lambda v: F.col("ordinal") >= v,
            "ordinal_max": lambda v: F.col("ordinal") <= v,
            "blocks": lambda v: F.col("block_id").isin(list(v)),
            "pages": lambda v: F.col("page").isin(list(v)),
            "unit_min": lambda v: F.col("unit_id") >= v,
            "unit_max": lambda v: F.col("unit_id") <= v,
            "words_min": lambda v: F.col("n_words") >= v,
            "words_max": lambda v: F.col("n_words") <= v,
        }
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and value != [] and value != ():
                units = units.where(rules[f.name](value))
        return units


@dataclass(frozen=True)
class FeatureFilter:
    """Equality predicates on occurrence columns; affixes are left out unless asked for."""

    equals: tuple[tuple[str, str], ...] = ()
    with_affixes: bool = False

    def apply(self, occurrences: DataFrame) -> DataFrame:
        for column, value in self.equals:
            occurrences = occurrences.where(F.col(column) == value)
        if not self.with_affixes and {"is_prefix", "is_suffix"} <= set(occurrences.columns):
            occurrences = occurrences.where(~F.coalesce("is_prefix", F.lit(False)) & ~F.coalesce("is_suffix", F.lit(False)))
        return occurrences

"""Exhaustive retrieval: totals that a page never changes, breakdowns, phrases, units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as T
from verbatlas.operators.filters import CorpusFilter, FeatureFilter


def matching(occurrences: DataFrame, units: DataFrame, terms: Sequence[str] | None = None, lemmas: Sequence[str] | None = None, filters: CorpusFilter | None = None, features: FeatureFilter | None = None) -> DataFrame:
    """Occurrences of any of the terms or lemmas (all, if none is named) in units that pass the filters.

    The selective predicate runs on the scan; units join on unit_id.
    """
    found = (features or FeatureFilter()).apply(occurrences)
    if terms is not None:
        found = found.where(F.col("term").isin(list(terms)))
    if lemmas is not None:
        found = found.where(F.col("lemma").isin(list(lemmas)))
    kept = (filters or CorpusFilter()).apply(units)
    extra = [c for c in kept.columns if c == "unit_id" or c not in found.columns]
    return found.join(kept.select(extra), "unit_id")


def totals(found: DataFrame) -> DataFrame:
    """One row: all hits and their distinct units; an empty frame gives zeros, null units count in total only."""
    return found.agg(F.count("*").alias("total"), F.countDistinct("unit_id").alias("units"))


def by(found: DataFrame, *keys: str) -> DataFrame:
    """Hits and distinct units by ``keys``; null keys are a group of their own."""
    return found.groupBy(*keys).agg(F.count("*").alias("total"), F.countDistinct("unit_id").alias("units"))


def page(found: DataFrame, order: Sequence[str] = ("unit_id", "position"), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """One page of hits in order; totals come from the same frame unpaged. ``limit`` 0 is no hit, None all."""
    hits = found.orderBy(*order).offset(offset)
    return hits if limit is None else hits.limit(limit)


def merged(found: DataFrame) -> DataFrame:
    """A row for each unit: its sorted distinct positions and the number of matches."""
    return found.groupBy("unit_id").agg(F.array_sort(F.collect_set("position")).alias("positions"), F.count("*").alias("matches"))


def hydrate(hits: DataFrame, words: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with their word's text and their unit's text and reference."""
    cited = units.select("unit_id", "section_id", "unit_num", F.col("text").alias("unit_text"))
    return hits.join(words.select("unit_id", "position", F.col("text").alias("word_text")), ["unit_id", "position"], "left").join(cited, "unit_id").withColumn("ref", F.concat_ws(":", "section_id", "unit_num"))


def phrase_search(units: DataFrame, phrase: str, strict: Column | None = None, loose: Column | None = None, phrase_strict: Column | None = None, phrase_loose: Column | None = None) -> DataFrame:
    """Units that hold the phrase, with the tier that found them.

    The strict twin decides; the loose twin is used only if the strict one finds nothing at all.
    Both are plain substring tests (no wildcards). One scan tests both tiers, one aggregate over the
    few hits decides between them. An empty phrase is refused.
    """
    strict = strict if strict is not None else T.search_form(F.col("text"))
    loose = loose if loose is not None else T.loose_form(F.col("text"))
    p_strict = phrase_strict if phrase_strict is not None else T.search_form(F.lit(phrase))
    p_loose = phrase_loose if phrase_loose is not None else T.loose_form(F.lit(phrase))
    if not phrase.strip():
        raise ValueError("an empty phrase would match everything")
    tested = units.withColumns({"_s": strict, "_l": loose, "_ps": p_strict, "_pl": p_loose})
    tested = tested.withColumns({"_in_s": (F.length("_ps") > 0) & F.contains("_s", "_ps"), "_in_l": (F.length("_pl") > 0) & F.contains("_l", "_pl")}).where("_in_s or _in_l")
    any_strict = tested.agg(F.coalesce(F.max(F.col("_in_s").cast("int")), F.lit(0)).alias("_any"))
    chosen = tested.join(F.broadcast(any_strict)).where(F.col("_in_s") | ((F.col("_any") == 0) & F.col("_in_l")))  # a one-row side
    tier = F.when(F.col("_any") == 1, "exact").otherwise("loose")
    count = F.when(F.col("_any") == 1, T.occurrences_of(F.col("_s"), F.col("_ps"))).otherwise(T.occurrences_of(F.col("_l"), F.col("_pl")))
    return chosen.withColumns({"tier": tier, "occurrences": count}).drop("_s", "_l", "_ps", "_pl", "_in_s", "_in_l", "_any")


def phrase_positions(hits: DataFrame, phrase: Column, text: Column) -> DataFrame:
    """``hits`` with the 1-based word positions of the phrase; none where it does not stand or the text is null."""
    return hits.withColumn("positions", T.positions_of(T.words(text), T.words(phrase)))


def unit_with_editions(units: DataFrame, translations: DataFrame, section: int, num: int) -> DataFrame:
    """One unit with its texts in all editions as a sorted array."""
    one = units.where((F.col("section_id") == section) & (F.col("unit_num") == num))
    texts = translations.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("edition", F.col("text").alias("text")))).alias("editions"))
    return one.join(texts, "unit_id", "left")


def unit_range(units: DataFrame, section: int, start: int, end: int) -> DataFrame:
    """Units of a section from ``start`` to ``end``, both included, in order; none if the range is empty."""
    return units.where((F.col("section_id") == section) & F.col("unit_num").between(start, end)).orderBy("unit_num")


def nested_analysis(occurrences: DataFrame) -> DataFrame:
    """unit_id, array of words, each with its sorted segments."""
    segment = F.struct("seg", "form", "term", "lemma")
    per_word = occurrences.groupBy("unit_id", "position").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    return per_word.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("position", "segments"))).alias("words"))


def profile(found: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of one filtered frame by several groupings in a single pass: ``grouping`` names the columns, ``value`` joins them."""
    columns = sorted({c for g in groups for c in g})
    view = found.select(*columns)
    name = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.concat_ws("|", *[F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return view.groupingSets([list(map(F.col, g)) for g in groups], *columns).agg(F.count("*").alias("total"), name.alias("grouping"), value.alias("value")).select("grouping", "value", "total")


def section_list(units: DataFrame) -> DataFrame:
    """section_id, ordinal, units, words of every section; units without a section are listed under null."""
    return units.groupBy("section_id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("units"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))


def corpus_totals(units: DataFrame, expected: int | None = None) -> DataFrame:
    """One row of counts, with whether ``expected`` units are there (null if none is named); an empty corpus counts 0."""
    out = units.agg(F.count("*").alias("units"), F.countDistinct("section_id").alias("sections"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.max("n_words"), F.lit(0)).alias("longest"))
    return out.withColumn("complete", F.lit(None).cast("boolean") if expected is None else F.col("units") == expected)


def points_in_ranges(points: DataFrame, ranges: DataFrame, section: str, at: str, start: str, end: str) -> DataFrame:
    """``points`` joined to the ``ranges`` of their section that hold them, both ends included; other names of the two differ.

    A range lies in one or two bins of its level, the smallest power of two that is no shorter than it; a point lies in one bin of each level that occurs (at most 64).
    They meet by (section, level, bin), so a point meets only ranges in whose bin it lies: at most those that begin within twice their length of it, whatever the size of the section.
    Each range and point meets once. Null ends, sections or points and ranges that end before they start hold nothing; repeated rows stay.
    """
    length = (F.col(end).cast("long") - F.col(start).cast("long")).cast("long")
    level = F.when(length > 0, F.length(F.bin(length))).otherwise(0)
    shifted = lambda c: F.expr(f"shiftright(cast(`{c}` AS bigint), _level)")
    binned = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = [r[0] for r in binned.select("_level").distinct().collect()]  # at most 64
    binned = binned.withColumn("_bin", F.explode(F.sequence(shifted(start), shifted(end))))
    placed = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", shifted(at))
    return placed.join(binned, [section, "_level", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bin")


def covering_notes(notes: DataFrame, points: DataFrame, chars: int = 4000) -> DataFrame:
    """Range notes over each point (section_id, unit_num), one an edition, oldest author first, cut with a flag.

    ``notes``: section_id, unit_start, unit_end, edition, year, text. Of an edition's notes over a point the one that starts first stands (then ends first, then by text): the
    least of them is an aggregate, so a point under many notes is not sorted. A null year comes last; a null edition is an edition.
    """
    hits = points_in_ranges(points, notes.select("section_id", "unit_start", "unit_end", "edition", "year", "text"), "section_id", "unit_num", "unit_start", "unit_end")
    rest = [c for c in points.columns if c not in ("section_id", "unit_num")]
    first = F.min(F.struct("unit_start", "unit_end", "text", "year"))
    one = hits.groupBy("section_id", "unit_num", "edition", *rest).agg(first.alias("_first")).select("section_id", "unit_num", *rest, "_first.unit_start", "_first.unit_end", "edition", "_first.year", "_first.text")
    order = Window.partitionBy("section_id", "unit_num").orderBy(F.coalesce("year", F.lit(9999)), "edition")
    return one.withColumns({"rank": F.row_number().over(order), "truncated": F.length("text") > chars, "text": F.substring("text", 1, chars)})


def quoting_documents(links: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """External documents that quote each unit, with their grading, best link first."""
    order = Window.partitionBy("unit_id").orderBy(F.desc("confidence"), "doc_id")
    return links.join(documents, "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def word_at(words: DataFrame, occurrences: DataFrame, section: int, num: int, position: int, units: DataFrame) -> DataFrame:
    """One word and its stem occurrence."""
    unit = units.where((F.col("section_id") == section) & (F.col("unit_num") == num)).select("unit_id")
    stems = FeatureFilter().apply(occurrences).where(F.col("position") == position)
    return words.where(F.col("position") == position).join(unit, "unit_id").join(stems.select("unit_id", "term", "lemma"), "unit_id", "left")

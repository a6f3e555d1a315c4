"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.operators.joins import lookup
from verbatlas.sources.shared import stash

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are whole numbers below 2**RANK_BITS; each histogram pass resolves HIST_BITS of them.
RANK_BITS, HIST_BITS = 48, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): shares of the sum by weight, filled up to a cap.

    Sources in code-point order, null last, take ``weights`` in turn. A source's target stops at
    ``max_repeat`` times its size and the excess is shared out again by weight. In the order of
    cap / weight the capped sources come first, so running sums find the common level in one pass
    over the sources (one row each).
    """
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeat)
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.asc_nulls_last("source"))
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns({"_rank": F.row_number().over(order), "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_sum": F.sum("source_size").over(all_rows), "_w_sum": F.sum("_w").over(all_rows)})
    level = F.try_divide(F.col("_sum") - F.col("_cap_before"), F.col("_w_sum") - F.col("_w_before"))
    ranked = ranked.withColumns({"_level": level, "_free": F.col("_cap") > level * F.col("_w")})
    first_free = F.min(F.when(F.col("_free"), F.struct("_rank", "_level"))).over(all_rows)
    ranked = ranked.withColumn("_first", first_free)
    capped = F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank"))
    return ranked.select("source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_first._level") * F.col("_w")).alias("target"))


def propensity(size: Column) -> Column:
    """How strongly a document is wanted beside others of its source: the number of binary digits of its size."""
    return F.length(F.bin(size)).cast("long")


def expected_copies(classes: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """``targets`` with what each class of a source expects, and the words left to the draw.

    ``classes``: source, w, words (documents of one propensity, some dozens a source). Copies are in proportion to w
    and at most ``max_repeat``, and sum to the target: classes with large w stop at the cap first, so running sums in that
    order find the common level. Whole copies are certain; the rest is the class's inclusion probability.

    Adds rule (map of w to whole and part), budget (words left), odds (of the part of open words that the budget is).
    """
    ranked = lookup(classes, targets.select("source", "target"), "source")
    order = Window.partitionBy("source").orderBy(F.desc("w"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"_capped": F.coalesce(F.sum("words").over(before), F.lit(0)) * max_repeat, "_rest": F.sum(F.col("w") * F.col("words")).over(Window.partitionBy("source")) - F.coalesce(F.sum(F.col("w") * F.col("words")).over(before), F.lit(0))})
    level = F.try_divide(F.col("target") - F.col("_capped"), F.col("_rest"))
    free = F.max(F.when(level * F.col("w") <= max_repeat, F.struct("w", level.alias("level")))).over(Window.partitionBy("source"))
    expected = F.when(free.isNull() | (F.col("w") > free["w"]), F.lit(float(max_repeat))).otherwise(free["level"] * F.col("w"))
    ranked = ranked.withColumn("_copies", expected).withColumn("whole", F.floor("_copies").cast("long")).withColumn("part", F.col("_copies") - F.col("whole"))
    rules = ranked.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("w", F.struct("whole", "part")))).alias("rule"), F.sum(F.col("whole") * F.col("words")).alias("_sure"), F.sum(F.when(F.col("part") > 0, F.col("words")).otherwise(0)).alias("_open")
    )
    out = lookup(targets, rules, "source").withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("_sure")))
    share = F.least(F.greatest(F.coalesce(F.try_divide("budget", "_open"), F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return out.select("source", "source_size", "target", "rule", "budget", (share / (1 - share)).alias("odds"))


def pareto_rank(uniform: Column, inclusion: Column, scale: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to whole numbers in the same order; null where nothing is drawn.

    ``scale`` is one number a source; it brings the ranks where the draw will end near the middle of their range.
    """
    odds = F.try_divide(inclusion, 1 - inclusion)
    ratio = F.try_divide(uniform / (1 - uniform), odds) * scale
    return F.floor(ratio / (1 + ratio) * F.lit(float(2**RANK_BITS))).cast("long")


def uniform_of(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def draw_within_budget(rows: DataFrame) -> DataFrame:
    """The last rank that each source takes: the longest prefix in rank order within its budget of words.

    ``rows``: source, budget, size, rank, id. Two histogram passes over the leading bits of the
    rank find the cell where the budget runs out; only that cell's rows (a 2**24th of a source) are
    put in order. No task gathers a source.
    """
    found = rows.select("source").distinct().select("source", F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_before"))
    shift = RANK_BITS
    for _ in range(2):
        shift -= HIST_BITS
        inside = lookup(rows, found, "source")
        inside = inside.where(F.col("rank").between(F.col("_low"), F.col("_low") + (1 << (shift + HIST_BITS)) - 1))
        cells = inside.groupBy("source", "budget", "_before", F.shiftright("rank", shift).alias("_cell")).agg(F.sum("size").alias("_words"))
        upto = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("_upto", F.col("_before") + F.sum("_words").over(upto))
        found = cells.where(F.col("_upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_words")).alias("_b"))).alias("_x")).select("source", (F.col("_x._cell") * (1 << shift)).alias("_low"), F.col("_x._b").alias("_before"))
    inside = lookup(rows, found, "source")
    inside = inside.where(F.col("rank").between(F.col("_low"), F.col("_low") + (1 << shift) - 1))
    ranks = inside.groupBy("source", "budget", "_low", "_before", "rank").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranks.withColumn("_upto", F.col("_before") + F.sum("_words").over(upto))
    return ranks.groupBy("source", "_low").agg(F.max(F.when(F.col("_upto") <= F.col("budget"), F.col("rank"))).alias("_last")).select("source", F.coalesce("_last", F.col("_low") - 1).alias("last_rank"))


def mix_to_targets(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix-1", closing_draws: int = 2) -> DataFrame:
    """How many words the mix takes of every document, so that each source's sum comes near its target.

    A document's expected copies are in proportion to its ``propensity`` (long documents are wanted more) and sum, in
    words, to its source's target. The whole part is certain, the rest is its inclusion probability, which differs from
    document to document, in a Pareto sample of fixed size (in words) from its source: documents are ranked by random odds
    over inclusion odds, and the sample is the prefix of that order that fits the words left. Documents are
    not divisible, so each of ``closing_draws`` then adds the one document of the rest whose size is nearest to the gap: two documents a
    source at most, a rounding of the fixed size. Sampling depends on seed, id and text alone: reruns agree.

    Returns id, size, source, source_size, target, taken (size times copies), copies. Null texts and
    texts without words have size 0 and take nothing; a null source is a source of its own. Rows that agree in id, source and
    text are interchangeable and drawn one by one; null ids are ids like others. An empty table gives an empty result. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.md5(text).alias("_text"))
    groups = slim.groupBy("id", "source", "size", "_text").agg(F.count("*").alias("_n"))
    numbered = groups.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "_text", F.col("_k").cast("string"))
    rows = stash(numbered.select("id", "source", "size", propensity(F.col("size")).alias("w"), uniform_of(key, seed).alias("uniform")), "mix-rows")
    classes = stash(rows.groupBy("source", "w").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    targets = stash(expected_copies(classes, targets, max_repeat), "mix-targets")

    def ranked(frame: DataFrame) -> DataFrame:
        """``frame`` with its whole copies, and its rank if there is something to draw."""
        own = F.col("rule")[F.col("w")]
        frame = frame.withColumns({"whole": own["whole"], "part": own["part"]})
        return frame.withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), pareto_rank(F.col("uniform"), F.col("part"), F.col("odds"))))

    draw = ranked(lookup(rows, targets, "source")).where(F.col("rank").isNotNull()).select("id", "source", "budget", "size", "rank")
    last = stash(draw_within_budget(draw), "mix-last")
    # A source whose open rows all fit its budget has no row in ``last``: it takes all of them.
    drawn = lookup(draw, last, "source", "left")
    drawn = stash(drawn.withColumn("in", F.col("last_rank").isNull() | (F.col("rank") <= F.col("last_rank"))), "mix-drawn")
    extra = None
    for _ in range(closing_draws):
        out = drawn
        if extra is not None:
            out = lookup(drawn, extra, "source", "left")
            out = out.withColumn("in", F.col("in") | F.coalesce(F.array_contains("more", F.col("rank")), F.lit(False)))
        gaps = out.groupBy("source", "budget").agg(F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("got")).select("source", (F.col("budget") - F.col("got")).alias("gap"))
        out = out.where(~F.col("in")).groupBy("source", "rank").agg(F.sum("size").alias("size"))
        out = lookup(out, gaps, "source").where(F.col("size") < 2 * F.col("gap"))
        one = out.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("far"), "rank")).alias("x")).select("source", F.array("x.rank").alias("more"))
        if extra is not None:
            one = lookup(extra.withColumnRenamed("more", "old"), one, "source", "left").select("source", F.concat("old", F.coalesce("more", F.array().cast("array<bigint>"))).alias("more"))
        extra = stash(one, "mix-extra")
    rule = lookup(targets, last, "source", "left")
    rule = lookup(rule, extra, "source", "left") if extra is not None else rule.withColumn("more", F.lit(None).cast("array<bigint>"))
    final = ranked(lookup(rows, rule, "source"))
    sampled = F.col("rank").isNotNull() & (F.col("last_rank").isNull() | (F.col("rank") <= F.col("last_rank")) | F.coalesce(F.array_contains("more", F.col("rank")), F.lit(False)))
    final = final.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + sampled.cast("long")).otherwise(F.lit(0).cast("long")))
    return final.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

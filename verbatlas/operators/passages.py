"""Passages around mentions, their motifs and differences; section structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.text import jaccard


def figures(occurrences: DataFrame) -> DataFrame:
    """lemma, units: figures by the number of units that mention them."""
    return occurrences.groupBy("lemma").agg(F.countDistinct("unit_id").alias("units"))


def merge_mentions(mentions: DataFrame, gap: int = 3, least: int = 1) -> DataFrame:
    """section_id, passage, start, end, mentions: mentioned units at most ``gap`` unmentioned ones apart.

    ``mentions``: section_id, unit_num, distinct. A section's mentions are put in order in one task; sections are bounded documents.
    """
    order = Window.partitionBy("section_id").orderBy("unit_num")
    new = (F.col("unit_num") - F.lag("unit_num").over(order) > gap + 1).cast("int")
    numbered = mentions.select("section_id", "unit_num").distinct().withColumn("_new", F.coalesce(new, F.lit(1)))
    runs = numbered.withColumn("passage", F.sum("_new").over(order))
    return runs.groupBy("section_id", "passage").agg(F.min("unit_num").alias("start"), F.max("unit_num").alias("end"), F.count("*").alias("mentions")).where(F.col("mentions") >= least)


def widen(passages: DataFrame, units: DataFrame, pad: int = 2) -> DataFrame:
    """Passage units: the passage and ``pad`` units on both sides, within the section."""
    wide = passages.withColumns({"from": F.greatest(F.lit(1), F.col("start") - pad), "to": F.col("end") + pad})
    return wide.join(units.select("section_id", "unit_num", "unit_id"), "section_id").where(F.col("unit_num").between(F.col("from"), F.col("to")))


def motifs(passage_units: DataFrame, occurrences: DataFrame, common: int = 500, top: int = 40) -> DataFrame:
    """section_id, passage, term, total, rank: a passage's most frequent terms, without those over ``common`` in the corpus."""
    rare = occurrences.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") < common).select("term")
    inside = occurrences.select("unit_id", "term").join(rare, "term").join(passage_units.select("section_id", "passage", "unit_id"), "unit_id")
    counts = inside.groupBy("section_id", "passage", "term").agg(F.count("*").alias("total"))
    order = Window.partitionBy("section_id", "passage").orderBy(F.desc("total"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def longest(passages: DataFrame, top: int = 12) -> DataFrame:
    """The ``top`` longest passages, numbered; ties by place."""
    return passages.withColumn("length", F.col("end") - F.col("start") + 1).orderBy(F.desc("length"), "section_id", "start").limit(top).withColumn("nr", F.row_number().over(Window.orderBy(F.desc("length"), "section_id", "start")))


def passage_differences(chosen: DataFrame, motif_rows: DataFrame) -> DataFrame:
    """section_id, passage, motifs, shared_by_all, adds (in no other passage), omits (of those in some other), inversions, pairs.

    Inversions count motif pairs whose rank order differs from the longest passage's, out of the pairs both have.
    """
    m = motif_rows.join(chosen.select("section_id", "passage", "nr"), ["section_id", "passage"])
    frequency = m.groupBy("term").agg(F.count("*").alias("passages"))
    n = chosen.agg(F.count("*").alias("n"))
    vocabulary = frequency.agg(F.count("*").alias("terms"), F.coalesce(F.sum((F.col("passages") == 1).cast("int")), F.lit(0)).alias("singles"))
    per = m.join(frequency, "term").join(F.broadcast(n)).groupBy("section_id", "passage", "nr").agg(F.count("*").alias("motifs"), F.sum((F.col("passages") == F.col("n")).cast("int")).alias("shared_by_all"), F.sum((F.col("passages") == 1).cast("int")).alias("adds"))
    omitted = per.join(F.broadcast(vocabulary)).withColumn("omits", F.col("terms") - F.col("motifs"))
    base = m.where("nr = 1").select("term", F.col("rank").alias("base_rank"))
    ranked = m.join(base, "term").select("section_id", "passage", "term", "rank", "base_rank")
    x, y = ranked.alias("x"), ranked.select("section_id", "passage", F.col("term").alias("term2"), F.col("rank").alias("rank2"), F.col("base_rank").alias("base2")).alias("y")
    pairs = x.join(y, ["section_id", "passage"]).where("base_rank < base2")
    turned = pairs.groupBy("section_id", "passage").agg(F.count("*").alias("pairs"), F.sum((F.col("rank") > F.col("rank2")).cast("int")).alias("inversions"))
    out = omitted.join(turned, ["section_id", "passage"], "left")
    return out.select("section_id", "passage", "nr", "motifs", "shared_by_all", "adds", "omits", F.coalesce("inversions", F.lit(0)).alias("inversions"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


# -- section structure


def content_sets(occurrences: DataFrame, units: DataFrame, common: int = 400) -> DataFrame:
    """Units with their distinct content terms: those with at most ``common`` occurrences."""
    rare = occurrences.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= common).select("term")
    sets = occurrences.select("unit_id", "term").join(rare, "term").groupBy("unit_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return units.select("section_id", "unit_num", "unit_id").join(sets, "unit_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def cohesion(sets: DataFrame) -> DataFrame:
    """section_id, unit_num, cohesion with the next unit; 0 if either has no content term."""
    nxt = F.lead("terms").over(Window.partitionBy("section_id").orderBy("unit_num"))
    return sets.withColumn("_next", nxt).where(F.col("_next").isNotNull()).select("section_id", "unit_num", jaccard(F.col("terms"), F.col("_next")).alias("cohesion"))


def boundaries(cohesions: DataFrame, parts: int = 12) -> DataFrame:
    """Passages of a section: breaks where three neighbouring cohesions are 0, every ``step``-th of them, and the ends.

    section_id, start, end, units, mean_cohesion; sections of under four units give none.
    """
    order = Window.partitionBy("section_id").orderBy("unit_num")
    c = cohesions.withColumns({"_before": F.lag("cohesion").over(order), "_after": F.lead("cohesion").over(order), "_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("section_id")) + 1})
    c = c.where("_n >= 4").withColumn("_zero", F.coalesce((F.col("cohesion") == 0) & (F.col("_before") == 0) & (F.col("_after") == 0), F.lit(False)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    nth = F.row_number().over(Window.partitionBy("section_id", "_zero").orderBy("unit_num")) - 1
    kept = c.withColumn("_nth", nth).withColumn("_break", (F.col("_i") == 0) | (F.col("_zero") & (F.pmod(F.col("_nth"), step) == 0)))
    runs = kept.withColumn("_run", F.sum(F.col("_break").cast("int")).over(order))
    return runs.groupBy("section_id", "_run").agg(F.min("unit_num").alias("start"), (F.max("unit_num") + 1).alias("end"), (F.count("*") + 1).alias("units"), F.avg("cohesion").alias("mean_cohesion")).drop("_run")


def ring_scores(sets: DataFrame) -> DataFrame:
    """section_id, mirror, background, candidate: similarity of mirrored units against strided other pairs."""
    order, every = Window.partitionBy("section_id").orderBy("unit_num"), Window.partitionBy("section_id")
    s = sets.select("section_id", "terms", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(every).alias("n"))
    other = s.select("section_id", F.col("terms").alias("terms2"), F.col("i").alias("j"))
    mirrored = s.withColumn("j", F.col("n") - 1 - F.col("i")).join(other, ["section_id", "j"]).where(F.col("i") < F.floor(F.col("n") / 2))
    mirror = mirrored.groupBy("section_id").agg(F.round(F.avg(jaccard(F.col("terms"), F.col("terms2"))), 4).alias("mirror"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    near = s.where(F.pmod(F.col("i"), stride) == 0).select("section_id", "terms", "i", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("_k"), "n").withColumn("j", (F.col("i") + 2 + F.col("_k") * stride).cast("int")).where("j < n").join(other, ["section_id", "j"])
    background = near.groupBy("section_id").agg(F.round(F.avg(jaccard(F.col("terms"), F.col("terms2"))), 4).alias("background"))
    out = s.select("section_id").distinct().join(mirror, "section_id", "left").join(background, "section_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("mirror", "background")})
    return out.withColumn("candidate", (F.col("mirror") > F.col("background") * 1.5) & (F.col("mirror") > 0.05))

"""Batch claim testing: every claim of a table in one job, counter-examples before support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.stats import assess, loaded_numbers
from verbatlas.functions.text import run_hash, run_hashes, words
from verbatlas.operators.cooccurrence import SCOPES

TYPES = ("always_with", "never_with", "mostly_with", "distribution", "conditional")


def validate(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason). ``claims``: claim_id, claim_type, subject (array), object (array), scope, cohort, threshold."""
    reason = (
        F.when(~F.coalesce(F.col("claim_type").isin(*TYPES), F.lit(False)), "unknown claim type")
        .when(~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "unknown scope")
        .when(F.coalesce(F.size("subject"), F.lit(0)) < 1, "no subject")
        .when(F.col("claim_type").isin("always_with", "never_with", "mostly_with") & (F.coalesce(F.size("object"), F.lit(0)) < 1), "no object")
        .when(~F.coalesce(F.col("threshold").between(0, 1), F.lit(True)), "threshold outside 0..1")
    )
    checked = claims.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def resolve_terms(claims: DataFrame, lexicon: DataFrame, most: int | None = None) -> DataFrame:
    """claim_id, term, surface, at, order: terms named in a claim's text, in order of first mention.

    ``lexicon``: surface (lower case), term. Each term is found by its longest surface that stands there between word borders; surfaces of
    one or two characters or without a word are left out, and so are null texts, surfaces and terms. Repeated rows of the lexicon count once.

    A surface meets the texts that hold all of its words in a row, by a hash of that run, never those that merely share a word with it; a text makes a row for each of its
    runs and each number of words that a surface has (a lexicon has few: they are read first). Texts travel once, to the surfaces found in them, where signs between words
    are compared too. Rows of one claim_id are one claim: their mentions meet.
    """
    entries = lexicon.where((F.length("surface") > 2) & F.col("term").isNotNull()).select("surface", "term", words(F.col("surface")).alias("_w")).where(F.size("_w") > 0).withColumn("_n", F.size("_w")).distinct()
    lengths = sorted(r[0] for r in entries.select("_n").distinct().collect())
    by_length = F.lit(None).cast("bigint")
    for n in lengths:
        by_length = F.when(F.col("_n") == n, run_hash(*[F.xxhash64(F.get("_w", F.lit(j))) for j in range(n)])).otherwise(by_length)
    entries = entries.select("surface", "term", by_length.alias("_run"))
    text = claims.where(F.col("text").isNotNull()).select("claim_id", F.lower("text").alias("text"))
    runs = text.select("claim_id", F.explode(run_hashes(words(F.col("text")), lengths) if lengths else F.array().cast("array<bigint>")).alias("_run")).join(entries.select("_run").distinct(), "_run", "left_semi").distinct()
    hits = runs.join(entries, "_run").join(text, "claim_id").withColumn("at", F.regexp_instr(F.col("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("surface"), F.lit(r"\E(?![\p{L}\p{N}])")))).where("at > 0")
    best = F.min(F.struct((-F.length("surface")).alias("_l"), "surface", "at"))
    one = hits.groupBy("claim_id", "term").agg(best.alias("_best")).select("claim_id", "term", "_best.surface", "_best.at")
    out = one.withColumn("order", F.row_number().over(Window.partitionBy("claim_id").orderBy("at", "term"))).select("claim_id", "term", "surface", "at", "order")
    return out if most is None else out.where(F.col("order") <= most)


def claim_type_of(text: Column, markers: dict[str, list[str]], default: str = "mostly_with") -> Column:
    """The first claim type of ``markers`` with a marker in the text."""
    out = F.lit(default)
    for kind, marks in reversed(list(markers.items())):
        test = F.lit(False)
        for w in marks:
            test = test | F.contains(F.lower(text), F.lit(w))
        out = F.when(test, kind).otherwise(out)
    return out


def unit_flags(claims: DataFrame, occurrences: DataFrame, units: DataFrame) -> DataFrame:
    """claim_id, key, unit_cohort, has_subject, has_object for every scope key that matters: those with either term set.

    Claim terms are exploded and joined to occurrences by term, so only matching occurrences are shuffled.
    """
    wanted = claims.select("claim_id", "scope", "cohort", F.explode("subject").alias("term"), F.lit(1).alias("s"), F.lit(0).alias("o")).unionByName(claims.select("claim_id", "scope", "cohort", F.explode("object").alias("term"), F.lit(0).alias("s"), F.lit(1).alias("o")))
    hits = wanted.join(occurrences, "term")
    key = F.when(F.col("scope") == "unit", F.concat_ws(":", *SCOPES["unit"])).when(F.col("scope") == "block", F.concat_ws(":", *SCOPES["block"])).otherwise(F.concat_ws(":", *SCOPES["section"]))
    return hits.groupBy("claim_id", key.alias("key"), "unit_cohort").agg(F.max("s").alias("has_subject"), F.max("o").alias("has_object"))


def _scope_totals(claims: DataFrame, units: DataFrame) -> DataFrame:
    """claim_id, universe: distinct scope keys inside the claim's cohort."""
    sizes = None
    for scope, keys in SCOPES.items():
        part = units.groupBy(F.col("cohort").alias("unit_cohort")).agg(F.count_distinct(*keys).alias("n")).withColumn("scope", F.lit(scope))
        every = units.agg(F.count_distinct(*keys).alias("n")).select(F.lit(None).cast("string").alias("unit_cohort"), "n", F.lit(scope).alias("scope"))
        both = part.unionByName(every)
        sizes = both if sizes is None else sizes.unionByName(both)
    return claims.select("claim_id", "scope", "cohort").join(sizes.withColumnRenamed("scope", "_s"), (F.col("scope") == F.col("_s")) & F.col("cohort").eqNullSafe(F.col("unit_cohort")), "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("universe"))


def test_claims(claims: DataFrame, occurrences: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, unit lists) for co-occurrence and distribution claims.

    Verdicts: claim_id, verdict, violating, supporting, subject_units, object_units, universe, coverage,
    baseline, sig, loaded. Unit lists: claim_id, key, role (violating or supporting), complete.
    The null hypothesis: the object stands in the subject's units at its rate over the whole scope.
    """
    occ = occurrences.select("term", "unit_id", "section_id", "block_id", F.col("cohort").alias("unit_cohort"))
    flags = unit_flags(claims, occ, units).join(claims.select("claim_id", "claim_type", F.col("cohort").alias("wanted"), F.coalesce("threshold", F.lit(0.5)).alias("threshold")), "claim_id")
    together = flags.where(F.col("claim_type") != "distribution").where(F.col("wanted").isNull() | (F.col("unit_cohort") == F.col("wanted")))
    # A block or section may hold units of both cohorts: its flags meet here.
    keyed = together.groupBy("claim_id", "claim_type", "threshold", "key").agg(F.max("has_subject").alias("s"), F.max("has_object").alias("o"))
    counts = keyed.groupBy("claim_id", "claim_type", "threshold").agg(F.sum("s").alias("subject_units"), F.sum("o").alias("object_units"), F.sum(F.col("s") * F.col("o")).alias("both")).join(_scope_totals(claims, units), "claim_id")
    share = F.when(F.col("universe") > 0, F.col("object_units") / F.col("universe")).otherwise(0.0)
    counts = counts.withColumns({"baseline": share, "coverage": F.when(F.col("subject_units") > 0, F.col("both") / F.col("subject_units")).otherwise(0.0)})
    counts = counts.withColumn("sig", assess(F.col("both"), F.col("subject_units"), F.col("baseline")))
    never = F.col("claim_type") == "never_with"
    only = F.col("subject_units") - F.col("both")
    counts = counts.withColumns({"violating": F.when(never, F.col("both")).otherwise(only), "supporting": F.when(never, only).otherwise(F.col("both"))})
    enough = F.col("coverage") >= F.col("threshold")
    verdict = (
        F.when(F.col("subject_units") == 0, "untestable")
        .when((F.col("claim_type") != "mostly_with") & (F.col("violating") == 0), "supported")
        .when(F.col("claim_type") != "mostly_with", "refuted")
        .when(enough & ~F.col("sig.within_chance"), "supported_with_caveats")
        .when(enough, "not_supported")
        .otherwise("refuted")
    )
    first = counts.withColumn("verdict", verdict)
    # Distribution: the subject's units in the cohort against the cohort's share of all units of the scope.
    spread = flags.where((F.col("claim_type") == "distribution") & (F.col("has_subject") == 1))
    spread_counts = spread.groupBy("claim_id", "claim_type", "threshold").agg(F.count_distinct("key").alias("subject_units"), F.count_distinct(F.when(F.col("unit_cohort") == F.col("wanted"), F.col("key"))).alias("both"))
    cohort_units = _scope_totals(claims, units).withColumnRenamed("universe", "object_units")
    all_units = _scope_totals(claims.withColumn("cohort", F.lit(None).cast("string")), units)
    spread_counts = spread_counts.join(cohort_units, "claim_id").join(all_units, "claim_id").withColumns({"baseline": F.coalesce(F.try_divide(F.col("object_units"), F.col("universe")), F.lit(0.0)), "coverage": F.col("both") / F.col("subject_units")})
    spread_counts = spread_counts.withColumn("sig", assess(F.col("both"), F.col("subject_units"), F.col("baseline"))).withColumns({"supporting": F.col("both"), "violating": F.col("subject_units") - F.col("both")})
    spread_verdict = F.when(F.col("sig.within_chance"), "not_supported").when((F.col("coverage") > F.col("baseline")) & (F.col("coverage") >= F.col("threshold")), "supported_with_caveats").otherwise("refuted")
    second = spread_counts.withColumn("verdict", spread_verdict)
    columns = ["claim_id", "verdict", "violating", "supporting", "subject_units", "object_units", "universe", "coverage", "baseline", "sig"]
    found = first.select(columns).unionByName(second.select(columns))
    silent = claims.where(F.col("claim_type") != "conditional").join(found, "claim_id", "left_anti")
    for c in columns[2:]:
        silent = silent.withColumn(c, F.lit(None).cast(found.schema[c].dataType) if c == "sig" else F.lit(0).cast(found.schema[c].dataType))
    verdicts = found.unionByName(silent.withColumn("verdict", F.lit("untestable")).select(columns))
    verdicts = verdicts.withColumn("loaded", loaded_numbers(F.array(*[F.col(c).cast("long") for c in ("violating", "supporting", "subject_units")]), F.col("universe").cast("long")))
    role = F.when((F.col("claim_type") == "never_with") == (F.col("o") == 1), "violating").otherwise("supporting")
    listed = keyed.where("s = 1").select("claim_id", "key", role.alias("role"))
    spread_list = spread.groupBy("claim_id", "key").agg(F.max((F.col("unit_cohort") == F.col("wanted")).cast("int")).alias("i")).select("claim_id", "key", F.when(F.col("i") == 1, "supporting").otherwise("violating").alias("role"))
    return verdicts, listed.unionByName(spread_list)


test_claims.__test__ = False


def describe(lists: DataFrame, sample: int = 50) -> DataFrame:
    """A capped sample of each claim's units, violations before support; the full lists stay as they are."""
    order = Window.partitionBy("claim_id", "role").orderBy("key")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).withColumn("part", F.when(F.col("role") == "violating", 0).otherwise(1)).orderBy("claim_id", "part", "rank")


def conditional_claims(claims: DataFrame, structures: DataFrame) -> DataFrame:
    """Descriptive: how often a claim's subject stands in either role, over all structures."""
    terms = claims.where("claim_type = 'conditional'").select("claim_id", F.explode("subject").alias("term"))
    rows = structures.select(F.struct("unit_id", "word_start").alias("_sid"), "condition_terms", "consequence_terms")
    sides = rows.select("_sid", F.explode("condition_terms").alias("term"), F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(rows.select("_sid", F.explode("consequence_terms").alias("term"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    per = sides.join(terms, "term").groupBy("claim_id", "_sid").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    return per.groupBy("claim_id").agg(F.sum("c").alias("as_condition"), F.sum("r").alias("as_consequence"), F.count("*").alias("either"))

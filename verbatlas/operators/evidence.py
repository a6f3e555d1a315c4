"""Evidence checks: spans, citations, placeholders, quotations, bibliographies, expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as T
from verbatlas.functions.text import run_hash, run_hashes
from verbatlas.sources.shared import stash

#: Most primary kinds first (fixed order); others follow.
KIND_RANK = {"ayah": 0, "morphology": 1, "tafsir": 2, "hadith": 3, "translation": 4, "lexicon": 5}


def span_id(kind: Column, ref: Column, edition: Column, text: Column) -> Column:
    """Stable id of a cited span: twelve digits of the SHA-256 of kind, ref, edition and the text's start. Null counts as ''."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (kind, ref, edition, F.substring(text, 1, 120))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def add_spans(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Both without repeated span ids of a run; the first agent in name order stays."""
    order = Window.partitionBy("run_id", "span_id").orderBy("agent", "query")
    return ledger.unionByName(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def parse_ref(ref: Column) -> Column:
    """struct<section_id, unit_num> of ``12:34``; null where it is no such reference."""
    good = ref.rlike(r"^\d{1,9}:\d{1,9}$")
    return F.when(good, F.struct(F.split(ref, ":")[0].cast("int").alias("section_id"), F.split(ref, ":")[1].cast("int").alias("unit_num")))


def check_citations(spans: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """``spans`` (kind, ref, edition) with ``resolves``: a unit reference names a unit, any other an external document of its edition."""
    parsed = spans.withColumn("_p", F.when(F.col("kind") != "hadith", parse_ref(F.col("ref"))))
    found_units = units.select("section_id", "unit_num").distinct().withColumn("_u", F.lit(True))
    found_docs = documents.select(F.col("edition"), F.col("number").cast("string").alias("ref")).distinct().withColumn("_d", F.lit(True))
    joined = parsed.join(found_units, (F.col("_p.section_id") == found_units["section_id"]) & (F.col("_p.unit_num") == found_units["unit_num"]), "left").drop("section_id", "unit_num").join(found_docs, ["edition", "ref"], "left")
    return joined.withColumn("resolves", F.coalesce(F.when(F.col("kind") == "hadith", F.col("_d")).otherwise(F.col("_u")), F.lit(False))).drop("_p", "_u", "_d")


def claim_support(claims: DataFrame, spans: DataFrame, retested: DataFrame | None = None) -> DataFrame:
    """``claims`` (claim_id, support array<span_id>, universal) with a status.

    refuted: a universal claim whose re-test (claim_id, verdict) refuted it; needs_evidence: no
    support that exists among ``spans``; open otherwise.
    """
    cited = claims.select("claim_id", F.explode("support").alias("span_id")).join(spans.select("span_id"), "span_id", "left_semi").select("claim_id").distinct().withColumn("_has", F.lit(True))
    out = claims.join(cited, "claim_id", "left")
    if retested is not None:
        out = out.join(retested.select("claim_id", "verdict"), "claim_id", "left")
    else:
        out = out.withColumn("verdict", F.lit(None).cast("string"))
    status = F.when(F.col("universal") & (F.col("verdict") == "refuted"), "refuted").when(F.col("_has").isNull(), "needs_evidence").otherwise("open")
    return out.withColumn("status", status).drop("_has")


def lacking_baseline(statistics: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Statistics whose baseline is null; repeated rows stay."""
    return statistics.where(F.col(baseline).isNull())


def report_verdict(claims: DataFrame, citations: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: blocked if a citation fails or a claim is refuted, qualified if evidence or a baseline lacks, else clear."""
    c = claims.agg(F.count_if(F.col("status") == "refuted").alias("refuted"), F.count_if(F.col("status") == "needs_evidence").alias("unsupported"))
    f = citations.agg(F.count_if(~F.col("resolves")).alias("failed"), F.count("*").alias("checked"))
    s = statistics.agg(F.count_if(F.col("baseline").isNull()).alias("no_baseline"))
    one = c.join(F.broadcast(f)).join(F.broadcast(s))  # one-row sides
    return one.withColumn("verdict", F.when((F.col("failed") > 0) | (F.col("refuted") > 0), "blocked").when((F.col("unsupported") > 0) | (F.col("no_baseline") > 0), "qualified").otherwise("clear"))


def render_placeholders(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Texts with their placeholders replaced by source texts, by join.

    ``documents``: doc_id, text. ``sources``: kind, ref, arg, text (arg '' for any edition). Gives
    doc_id, text, resolved, violations (array), citations (array of kind:ref|arg). A placeholder without a source becomes ``[UNRESOLVED kind:ref]``.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.split(body, T.PLACEHOLDER, -1)
    marks = F.posexplode_outer(T.placeholders(F.col("text")))
    exploded = documents.select("doc_id", marks.alias("pos", "mark"), pieces.alias("_pieces"))
    asked = exploded.select("doc_id", "pos", F.col("mark.kind").alias("kind"), F.col("mark.ref").alias("ref"), F.coalesce("mark.arg", F.lit("")).alias("arg"))
    first = sources.groupBy("kind", "ref", "arg").agg(F.min("text").alias("found"))
    solved = asked.where(F.col("kind").isNotNull()).join(first, ["kind", "ref", "arg"], "left")
    name = F.concat_ws(":", "kind", "ref")
    filled = solved.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("found", F.concat(F.lit("[UNRESOLVED "), name, F.lit("]"))).alias("t")))), lambda x: x["t"]).alias("fills"),
        F.count("found").alias("resolved"),
        F.array_sort(F.collect_list(F.when(F.col("found").isNull(), name))).alias("violations"),
        F.array_sort(F.collect_list(F.when(F.col("found").isNotNull(), F.concat(name, F.lit("|"), F.col("arg"))))).alias("citations"),
    )
    empty = F.array().cast("array<string>")
    out = documents.select("doc_id", pieces.alias("pieces")).join(filled, "doc_id", "left").withColumns({"fills": F.coalesce("fills", empty), "violations": F.coalesce("violations", empty), "citations": F.coalesce("citations", empty), "resolved": F.coalesce("resolved", F.lit(0))})
    joined = F.array_join(F.zip_with("pieces", "fills", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return out.select("doc_id", joined.alias("text"), "resolved", "violations", "citations")


def contained(needles: DataFrame, texts: DataFrame, key: str, needle: str, text: str, width: int = 16) -> DataFrame:
    """Distinct (key, needle) that stand somewhere inside a ``text`` of the same key, character by character.

    A text that holds a needle holds its first ``width`` characters (or all of a shorter one), so the two meet by (key, hash of those), never by key alone: a text makes a
    row for each of its runs of so many characters that some needle of its key begins with. A needle of up to ``width`` characters is then found. A longer one is compared with the
    text itself: first one text for each needle, then, for the few that are not in that one, all texts that hold its beginning. An empty needle
    stands in any text of its key, also an empty one. Null keys, needles and texts meet nothing; repeated rows count once.
    """
    wanted = stash(needles.where(F.col(key).isNotNull() & F.col(needle).isNotNull()).select(key, needle).distinct(), "needles")
    held = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).distinct()
    held = stash(held.withColumn("_s", F.concat(F.hex(F.xxhash64("_t")), F.hex(F.xxhash64(F.lit("second"), "_t")))), "haystacks")
    size = F.length(needle)
    lengths = sorted(r[0] for r in wanted.where(size > 0).select(F.least(size, F.lit(width)).alias("n")).distinct().collect())  # at most ``width``
    empty = wanted.where(size == 0).join(held.select(key).distinct(), key, "left_semi")
    if not lengths:
        return empty
    letters = lambda c: F.split(c, "")
    start = F.lit(None).cast("bigint")
    for n in lengths:
        start = F.when(F.least(size, F.lit(width)) == n, run_hash(*[F.xxhash64(F.get("_l", F.lit(i))) for i in range(n)])).otherwise(start)
    begun = wanted.where(size > 0).withColumn("_l", letters(F.substring(needle, 1, width))).select(key, needle, start.alias("_h"))
    found = held.select(key, "_s", F.explode(run_hashes(letters(F.col("_t")), lengths)).alias("_h")).join(begun.select(key, "_h").distinct(), [key, "_h"], "left_semi")
    found = stash(found, "beginnings")
    short = begun.where(size <= width).join(found.select(key, "_h").distinct(), [key, "_h"], "left_semi").select(key, needle)
    long = begun.where(size > width)
    body = held.select(key, "_s", "_t")

    def read(pairs: DataFrame) -> DataFrame:
        return pairs.join(body, [key, "_s"]).where(F.contains("_t", F.col(needle))).select(key, needle).distinct()

    proven = stash(read(long.join(found.groupBy(key, "_h").agg(F.min("_s").alias("_s")), [key, "_h"])), "proven")
    rest = read(long.join(proven, [key, needle], "left_anti").join(found, [key, "_h"]))
    return short.unionByName(proven).unionByName(rest).unionByName(empty)


def unverified_runs(documents: DataFrame, verified: DataFrame, runs: Column | None = None, form: Column | None = None) -> DataFrame:
    """run_id, run: quoted runs of documents (run_id, text) that occur in no verified text (run_id, text) of the same run.

    ``runs`` finds quotations in ``text`` (script runs by default), ``form`` folds ``text`` before the comparison. Each quotation of a run counts once; one without a run
    or in a run without verified texts is unverified.
    """
    prose = F.regexp_replace(F.col("text"), T.PLACEHOLDER, " ")
    found = runs if runs is not None else T.quoted_runs(prose)

    def folded(c: Column) -> Column:
        return T.search_form(c) if form is None else F.lower(c)

    quoted = stash(documents.select("run_id", F.explode(found).alias("run")).distinct().withColumn("_q", folded(F.col("run"))), "quoted")
    sources = verified.where(F.col("text").isNotNull()).select("run_id", folded(F.col("text")).alias("_v"))
    proven = contained(quoted, sources, "run_id", "_q", "_v")
    return quoted.join(proven, ["run_id", "_q"], "left_anti").select("run_id", "run")


def disagreements(notes: DataFrame) -> DataFrame:
    """section_id, unit_num, editions, n_editions for units with notes of more than one edition; notes stay apart."""
    return notes.groupBy("section_id", "unit_num").agg(F.array_sort(F.collect_set("edition")).alias("editions"), F.countDistinct("edition").alias("n_editions")).where("n_editions > 1")


def grading_audit(documents: DataFrame, weak: Sequence[str] = ("weak", "daif"), key: str | None = None) -> DataFrame:
    """total, ungraded (null or unknown) and weak documents, in all or by ``key``."""
    grade = F.lower(F.coalesce("grading", F.lit("unknown")))
    counts = [F.count("*").alias("total"), F.count_if(grade == "unknown").alias("ungraded"), F.count_if(grade.isin(*weak)).alias("weak")]
    return documents.groupBy(key).agg(*counts) if key else documents.agg(*counts)


def top_refs(spans: DataFrame, limit: int = 3) -> DataFrame:
    """run_id, ref, rank: each run's first distinct references."""
    first = spans.groupBy("run_id", "ref").agg(F.min("seq").alias("seq"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "ref"))).where(F.col("rank") <= limit)


def dominant_section(spans: DataFrame) -> DataFrame:
    """run_id, section_id that most of its unit references name; the smaller section on ties."""
    n = spans.select("run_id", parse_ref(F.col("ref"))["section_id"].alias("section_id")).where(F.col("section_id").isNotNull()).groupBy("run_id", "section_id").agg(F.count("*").alias("n"))
    return n.groupBy("run_id").agg(F.max_by("section_id", F.struct("n", -F.col("section_id"))).alias("section_id"))


def fingerprints(runs: DataFrame) -> DataFrame:
    """``runs`` (run_id, terms array, question) with the SHA-256 of their sorted distinct terms, else of the folded question."""
    terms = F.array_sort(F.array_distinct(F.coalesce("terms", F.array().cast("array<string>"))))
    basis = F.when(F.size(terms) > 0, F.array_join(terms, "|")).otherwise(F.trim(F.regexp_replace(F.lower(F.coalesce("question", F.lit(""))), r"\s+", " ")))
    return runs.withColumn("fingerprint", F.sha2(basis, 256))


def prior_runs(runs: DataFrame) -> DataFrame:
    """fingerprint, run_ids, n: work that was done more than once."""
    return fingerprints(runs).groupBy("fingerprint").agg(F.array_sort(F.collect_list("run_id")).alias("run_ids"), F.count("*").alias("n")).where("n > 1")


def bibliography(citations: DataFrame) -> DataFrame:
    """Distinct sources (kind, ref, edition_slug) with times_cited, in order: kind, date (null last), ref."""
    kind = F.coalesce("kind", F.lit("ayah"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), kind), F.lit(9))
    grouped = citations.groupBy("kind", "ref", "edition_slug").agg(F.count("*").alias("times_cited"), *[F.min(c).alias(c) for c in ("edition_name", "grading", "death_year") if c in citations.columns])
    year = F.coalesce(F.col("death_year"), F.lit(9999)) if "death_year" in citations.columns else F.lit(9999)
    return grouped.withColumns({"kind_rank": rank, "year_rank": year}).orderBy("kind_rank", "year_rank", F.coalesce("ref", F.lit("")), "edition_slug")


def licence_notice(entries: DataFrame, editions: DataFrame) -> DataFrame:
    """Licence lines of the editions that are cited."""
    return editions.join(entries.select("edition_slug"), editions["slug"] == entries["edition_slug"], "left_semi").select("slug", "name", "license").orderBy("slug")


def golden_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """item_id, tier, kind, passed, detail: expectations against result rows, joined by item.

    ``expected``: item_id, tier, kind, value (string), items (array<string>). ``actual``: item_id,
    value (string), items (array<string>), sample_complete (boolean). Kinds: count, field_equals,
    min_value, refs_exact, refs_include, verdict (items: counter-examples that must be listed unless
    the sample is cut), ordering (items come in this order), has_fields, partition (value is total,
    items are the parts), no_fabrication, citations_resolve (no items), render_fails (an item contains the value).
    A missing result fails.
    """
    a = actual.select("item_id", F.col("value").alias("got"), F.coalesce("items", F.array().cast("array<string>")).alias("got_items"), F.coalesce("sample_complete", F.lit(True)).alias("whole"))
    e = expected.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).join(a.withColumn("_there", F.lit(True)), "item_id", "left")
    missing = F.array_except("items", "got_items")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    parts = F.aggregate(F.transform("got_items", lambda x: x.try_cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    rules: Mapping[str, Column] = {
        "count": F.col("got") == F.col("value"),
        "field_equals": F.col("got") == F.col("value"),
        "min_value": F.coalesce(number("got"), F.lit(0.0)) >= number("value"),
        "refs_exact": F.array_sort(F.array_distinct("got_items")) == F.array_sort(F.array_distinct("items")),
        "refs_include": F.size(missing) == 0,
        "verdict": (F.col("got") == F.col("value")) & ((F.size(missing) == 0) | ~F.col("whole")),
        "ordering": F.filter("got_items", lambda x: F.array_contains("items", x)) == F.col("items"),
        "has_fields": F.size(missing) == 0,
        "partition": parts == number("got"),
        "no_fabrication": F.size("got_items") == 0,
        "citations_resolve": F.size("got_items") == 0,
        "render_fails": F.exists("got_items", lambda x: F.contains(x, F.col("value"))),
    }
    passed, detail = F.lit(False), F.lit("unknown kind")
    for kind, rule in rules.items():
        passed = F.when(F.col("kind") == kind, F.coalesce(rule, F.lit(False))).otherwise(passed)
        detail = F.when(F.col("kind") == kind, F.lit(kind)).otherwise(detail)
    lack = F.when(F.col("_there").isNull(), "no result").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).otherwise(detail)
    return e.select("item_id", "tier", "kind", (F.col("_there").isNotNull() & passed).alias("passed"), lack.alias("detail"))


def golden_summary(report: DataFrame) -> DataFrame:
    """tier, items, passed; a null outcome counts as not passed."""
    return report.groupBy("tier").agg(F.count("*").alias("items"), F.count_if("passed").alias("passed"))


def run_summary(claims: DataFrame) -> DataFrame:
    """run_id and its claims by status."""
    return claims.groupBy("run_id").agg(F.count("*").alias("claims"), *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "needs_evidence", "refuted", "verified")])

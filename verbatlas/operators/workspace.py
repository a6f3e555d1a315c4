"""Workspace tables: anchors, backlinks, version chains, reviews, topics, prior work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as T
from verbatlas.sources.shared import stash


def note_anchors(notes: DataFrame, units: DataFrame) -> DataFrame:
    """note_id, unit_id, quote: explicit references and those in the text, distinct, resolved by join; unknown ones are dropped.

    ``notes``: note_id, text, refs (array<string>).
    """
    refs = F.array_distinct(F.concat(F.coalesce("refs", F.array().cast("array<string>")), T.anchors(F.col("text"), T.UNIT_ANCHOR)))
    asked = notes.select("note_id", F.explode(refs).alias("ref"))
    known = units.select("unit_id", F.concat_ws(":", "section_id", "unit_num").alias("ref"), F.substring("text", 1, 200).alias("quote"))
    return asked.join(known, "ref").select("note_id", "unit_id", "quote")


def link_anchors(pages: DataFrame, id_col: str, html: Column) -> DataFrame:
    """page_id, href: distinct link targets of raw pages."""
    return pages.select(F.col(id_col).alias("page_id"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1))).alias("href"))


def backlinks(anchors: DataFrame, target: str, source: str) -> DataFrame:
    """target, sources (sorted, distinct), n."""
    return anchors.groupBy(target).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.countDistinct(source).alias("n"))


def version_chains(versions: DataFrame, max_rounds: int = 40) -> DataFrame:
    """id, root, depth for rows (id, parent_id): pointers double each round, so a chain of length n takes log2(n) rounds.

    A parent that does not exist ends the chain at its child. A cycle raises an error.
    """
    ids = versions.select(F.col("id").alias("_p"))
    now = versions.select("id", F.col("parent_id").alias("up")).join(ids, F.col("up") == F.col("_p"), "left").select("id", F.coalesce("_p", "id").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now = stash(now, "chains")
    for _ in range(max_rounds):
        parent = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        after = stash(now.join(parent, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "chains")
        moved = after.join(now.select("id", F.col("up").alias("old")), "id").where("up <> old").limit(1).count()
        now = after
        if not moved:
            return now.select("id", F.col("up").alias("root"), "depth")
    raise RuntimeError("a chain does not end")


#: Claim status after a test, by verdict (fixed values).
STATUS = {"supported": "supported", "supported_with_caveats": "supported_with_caveats", "not_supported": "not_supported", "refuted": "refuted", "untestable": "untestable"}


def stored_runs(verdicts: DataFrame, lists: DataFrame) -> DataFrame:
    """Verdict rows with their complete id lists, ready to append. The lists are results by contract; their size is a claim's."""
    both = lists.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "violating", F.col("key")))).alias("violating_ids"), F.array_sort(F.collect_list(F.when(F.col("role") == "supporting", F.col("key")))).alias("supporting_ids"))
    return verdicts.join(both, "claim_id", "left").withColumn("status", F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("verdict")))


def review_queue(findings: DataFrame, status: str = "in_review") -> DataFrame:
    """Findings of a status, oldest first, ties by id; a null status is in no queue."""
    return findings.where(F.col("status") == status).orderBy("created_at", "finding_id")


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings after valid reviews, rejected reviews). A finding's author may not review it; only findings in review can be."""
    joined = reviews.join(findings.select("finding_id", "author_id", "status"), "finding_id", "left")
    reason = F.when(F.col("author_id").isNull(), "no such finding").when(F.col("reviewer_id") == F.col("author_id"), "author reviews own finding").when(F.col("status") != "in_review", "not in review")
    checked = joined.withColumn("reason", reason)
    valid = checked.where(F.col("reason").isNull()).groupBy("finding_id").agg(F.max_by("approve", "reviewed_at").alias("_ok"))
    after = findings.join(valid, "finding_id", "left").withColumn("status", F.when(F.col("_ok"), "approved").when(~F.col("_ok"), "changes_requested").otherwise(F.col("status"))).drop("_ok")
    return after, checked.where(F.col("reason").isNotNull()).select(*reviews.columns, "reason")


def latest_runs(runs: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key (null times come first, ties by the other columns); an aggregate, so a frequent key gathers in no task."""
    rest = [c for c in runs.columns if c not in (key, at)]
    return runs.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_r")).select(*[key if c == key else F.col(f"_r.{c}").alias(c) for c in runs.columns])


def topic_collisions(topics: DataFrame, topic: Column, owner: str) -> DataFrame:
    """slug, owners, n: topics that several owners registered under one slug."""
    return topics.select(T.slug(topic).alias("slug"), owner).groupBy("slug").agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("n")).where("owners > 1")


def query_words(question: str, most: int = 6, least: int = 4) -> list[str]:
    """The first words of at least ``least`` characters."""
    return [w for w in question.lower().split() if len(w) >= least][:most]


def prior_work(findings: DataFrame, question: str, text: Column, order: Column, limit: int = 10) -> DataFrame:
    """Findings that hold any of the question's words, newest first; a question without such words finds nothing."""
    test = F.lit(False)
    for w in query_words(question):
        test = test | F.contains(F.lower(text), F.lit(w))
    return findings.where(test).orderBy(order.desc()).limit(limit)

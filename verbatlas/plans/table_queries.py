"""Registered queries over baskets, events, pages, vectors and conversations, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import claims as H
from verbatlas.operators import cooccurrence as C
from verbatlas.operators import evidence as E
from verbatlas.operators import retrieval as R
from verbatlas.operators import vectors as VEC
from verbatlas.operators import workspace as W
from verbatlas.operators.filters import CorpusFilter, FeatureFilter
from verbatlas.plans import views as V
from verbatlas.plans.registry import query
from verbatlas.sources import load as S
from verbatlas.sources.shared import shared_folder
from verbatlas.streaming import telemetry as M

BQ = f"WITH {V.B} "


# -- occurrences with features


@query("feature_search", BQ + "SELECT count(*) AS total, count(DISTINCT unit_id) AS units FROM b WHERE flag = 'R' AND status = 'F' AND cohort = 'A'")
def feature_search(spark, sf):
    b = CorpusFilter(cohort="A").apply(V.baskets(spark, sf))
    return R.totals(FeatureFilter((("flag", "R"), ("status", "F"))).apply(b))


@query("lemma_search", BQ + "SELECT section_id, count(*) AS total, count(DISTINCT unit_id) AS units FROM b WHERE lemma = (SELECT min(p_type) FROM part) GROUP BY section_id")
def lemma_search(spark, sf):
    first = V.table(spark, sf, "part").agg(F.min("p_type").alias("lemma"))
    return R.by(V.baskets(spark, sf).join(F.broadcast(first), "lemma", "left_semi"), "section_id")


@query("term_profile", BQ + """, x AS (SELECT * FROM b WHERE term = (SELECT min(p_brand) FROM part))
SELECT 'cohort' AS grouping, cohort AS value, count(*) AS total FROM x GROUP BY cohort UNION ALL SELECT 'flag,status', concat(flag, '|', status), count(*) FROM x GROUP BY flag, status
UNION ALL SELECT 'lemma', lemma, count(*) FROM x GROUP BY lemma UNION ALL SELECT 'section_id', cast(section_id AS varchar), count(*) FROM x GROUP BY section_id""")
def term_profile(spark, sf):
    first = V.table(spark, sf, "part").agg(F.min("p_brand").alias("term"))
    return R.profile(V.baskets(spark, sf).join(F.broadcast(first), "term", "left_semi"), [["cohort"], ["flag", "status"], ["lemma"], ["section_id"]])


@query("term_family_forms", BQ + "SELECT term, lemma, flag, status, cohort, count(*) AS total, count(DISTINCT unit_id) AS units FROM b GROUP BY ALL")
def term_family_forms(spark, sf):
    return R.by(V.baskets(spark, sf), "term", "lemma", "flag", "status", "cohort")


@query("nested_units", "SELECT o_orderkey AS unit_id, count(*) AS words, sum(n) AS segments FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def nested_units(spark, sf):
    line = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("seg"), F.col("l_returnflag").alias("form"), F.col("l_partkey").cast("string").alias("term"), F.col("l_linestatus").alias("lemma"))
    nested = R.nested_analysis(line)
    return nested.select("unit_id", F.size("words").cast("long").alias("words"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.size(w["segments"])).alias("segments"))


@query("unit_editions", "SELECT o_orderkey AS unit_id, string_agg(concat(l_linestatus, l_returnflag), ',' ORDER BY l_linestatus, l_returnflag) AS editions FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem) GROUP BY 1")
def unit_editions(spark, sf):
    line = V.table(spark, sf, "lineitem")
    last = line.agg(F.max("l_orderkey").alias("unit_id"))
    units = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.lit(1).alias("section_id"), F.lit(1).alias("unit_num")).join(F.broadcast(last), "unit_id", "left_semi")
    texts = line.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linestatus").alias("edition"), F.col("l_returnflag").alias("text")).join(F.broadcast(last), "unit_id", "left_semi")
    out = R.unit_with_editions(units, texts, 1, 1)
    return out.select("unit_id", F.array_join(F.transform("editions", lambda e: F.concat(e["edition"], e["text"])), ",").alias("editions"))


# -- co-occurrence

PAIRS = BQ + """, t AS (SELECT DISTINCT term, unit_id FROM b), n AS (SELECT term, count(*) AS n FROM t GROUP BY 1), tot AS (SELECT count(DISTINCT o_orderkey) AS total FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS n_ab FROM t x JOIN t y ON x.unit_id = y.unit_id AND x.term < y.term GROUP BY 1, 2),
q AS (SELECT p.a, p.b, n_ab, na.n AS n_a, nb.n AS n_b, total, log2(n_ab * total::DOUBLE / (na.n * nb.n::DOUBLE)) AS pmi FROM p JOIN n na ON a = na.term JOIN n nb ON b = nb.term, tot)"""


@query("pair_pmi", PAIRS + " SELECT a, b, n_a, n_b, n_ab, round(pmi, 5) AS pmi, round(pmi / -log2(n_ab / total), 5) AS npmi, round(n_ab / (n_a + n_b - n_ab), 6) AS jaccard, round(n_a * n_b / total, 4) AS expected FROM q")
def pair_pmi(spark, sf):
    out = C.measures(C.pair_counts(C.scope_terms(V.baskets(spark, sf))), C.scope_total(V.basket_units(spark, sf)))
    return out.select("a", "b", "n_a", "n_b", "n_ab", F.round("pmi", 5).alias("pmi"), F.round("npmi", 5).alias("npmi"), F.round("jaccard", 6).alias("jaccard"), F.round("expected", 4).alias("expected"))


BH = ", r AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS rank, count(*) OVER () AS m FROM s), k AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cp FROM r)"


@query("all_pairs_bh", PAIRS + f", s AS (SELECT *, {V.p_value('n_ab', 'n_a', 'n_b / total')} AS p FROM q)" + BH + " SELECT a, b, n_ab, round(p, 6) AS p_value, round(cp, 6) AS corrected_p, cp >= 0.05 AS within_chance FROM k")
def all_pairs_bh(spark, sf):
    out = C.all_pairs(V.baskets(spark, sf), V.basket_units(spark, sf))
    return out.select("a", "b", "n_ab", F.round("p_value", 6).alias("p_value"), F.round("corrected_p", 6).alias("corrected_p"), "within_chance")


@query("cluster_map", PAIRS + f", s AS (SELECT *, {V.p_value('n_ab', 'n_a', 'n_b / total')} AS p FROM q WHERE a IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33') AND b IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33') AND n_ab >= 2)" + BH + " SELECT a, b, n_ab, round(pmi, 5) AS pmi, round(cp, 6) AS corrected_p FROM k")
def cluster_map(spark, sf):
    out = C.cluster_map(V.baskets(spark, sf), V.basket_units(spark, sf), ["Brand#11", "Brand#12", "Brand#21", "Brand#33"])
    return out.select("a", "b", "n_ab", F.round("pmi", 5).alias("pmi"), F.round("corrected_p", 6).alias("corrected_p"))


@query("top_partners", BQ + f""", t AS (SELECT DISTINCT term, concat(section_id, ':', block_id) AS key FROM b), n AS (SELECT term, count(*) AS n FROM t GROUP BY 1), tot AS (SELECT count(*) AS total FROM (SELECT DISTINCT section_id, block_id FROM (WITH {V.BU} SELECT * FROM bu))),
q AS (SELECT 'Brand#11' AS a, y.term AS b, count(*) AS n_ab FROM t y WHERE y.term <> 'Brand#11' AND key IN (SELECT key FROM t WHERE term = 'Brand#11') GROUP BY y.term HAVING count(*) >= 3),
s AS (SELECT q.a, q.b, n_ab, na.n AS n_a, nb.n AS n_b, {V.p_value('n_ab', 'na.n', 'nb.n / total')} AS p FROM q JOIN n na ON na.term = q.a JOIN n nb ON nb.term = q.b, tot WHERE nb.n >= 5)""" + BH + " SELECT b, n_ab, round(cp, 6) AS corrected_p FROM k")
def top_partners(spark, sf):
    out = C.top_partners(V.baskets(spark, sf), V.basket_units(spark, sf), "Brand#11", "block", limit=1000)
    return out.select("b", "n_ab", F.round("corrected_p", 6).alias("corrected_p"))


# -- claims

CLAIMS = [
    (1, "always_with", ["Brand#11"], ["Brand#12"], "unit", None, None),
    (2, "never_with", ["Brand#21"], ["Brand#22"], "unit", "A", None),
    (3, "mostly_with", ["Brand#31"], ["Brand#32", "Brand#33", "Brand#34"], "unit", None, 0.1),
    (4, "mostly_with", ["Brand#41"], ["Brand#42"], "block", None, 0.9),
    (5, "distribution", ["Brand#11", "Brand#12"], [], "unit", "A", 0.3),
    (6, "always_with", ["no such brand"], ["Brand#12"], "unit", None, None),
    (7, "always_with", ["Brand#11"], ["Brand#12"], "section", None, None),
    (8, "mostly_with", ["Brand#51"], ["Brand#52"], "unit", "B", 0.05),
]
CSCHEMA = "claim_id long, claim_type string, subject array<string>, object array<string>, scope string, cohort string, threshold double"


def tested(spark, sf):
    claims = H.validate(spark.createDataFrame(CLAIMS, CSCHEMA))[0]
    return H.test_claims(claims, V.baskets(spark, sf), V.basket_units(spark, sf))


def claim_cte() -> str:
    rows = ", ".join(f"({i}, '{t}', {s!r}, {o!r}::VARCHAR[], '{sc}', {f'{c!r}' if c else 'NULL'}, {th if th is not None else 0.5})" for i, t, s, o, sc, c, th in CLAIMS)
    key = "CASE scope WHEN 'unit' THEN cast(unit_id AS varchar) WHEN 'block' THEN concat(section_id, ':', block_id) ELSE cast(section_id AS varchar) END"
    return f"""WITH {V.B}, {V.BU}, cl AS (SELECT * FROM (VALUES {rows}) v(claim_id, claim_type, subject, object, scope, wanted, threshold)),
f AS (SELECT claim_id, {key} AS key, max(list_contains(subject, term)::int) AS s, max(list_contains(object, term)::int) AS o, max((b.cohort = wanted)::int) AS inside FROM cl JOIN b ON list_contains(subject, term) OR list_contains(object, term)
 WHERE claim_type = 'distribution' OR wanted IS NULL OR wanted = b.cohort GROUP BY 1, 2),
un AS (SELECT claim_id, count(DISTINCT {key}) AS everything, count(DISTINCT {key}) FILTER (WHERE wanted IS NULL OR wanted = bu.cohort) AS inside FROM cl, bu GROUP BY 1),
su AS (SELECT claim_id, sum(s) AS s, sum(o) AS o, sum(s * o) AS so, sum(CASE WHEN s = 1 THEN coalesce(inside, 0) ELSE 0 END) AS si FROM f GROUP BY 1),
co AS (SELECT cl.*, coalesce(su.s, 0) AS su, CASE WHEN claim_type = 'distribution' THEN un.inside ELSE coalesce(su.o, 0) END AS ob, coalesce(CASE WHEN claim_type = 'distribution' THEN su.si ELSE su.so END, 0) AS k, CASE WHEN claim_type = 'distribution' THEN un.everything ELSE un.inside END AS un
 FROM cl LEFT JOIN su USING (claim_id) JOIN un USING (claim_id)),
t AS (SELECT *, {V.p_value('k', 'su', 'ob / un')} AS p FROM co),
v AS (SELECT claim_id, CASE WHEN su = 0 THEN 0 WHEN claim_type = 'never_with' THEN k ELSE su - k END AS violating, CASE WHEN su = 0 THEN 0 WHEN claim_type = 'never_with' THEN su - k ELSE k END AS supporting, su AS subject_units,
 CASE WHEN su = 0 THEN 'untestable' WHEN claim_type IN ('always_with', 'never_with') THEN CASE WHEN (claim_type = 'never_with' AND k = 0) OR (claim_type = 'always_with' AND su = k) THEN 'supported' ELSE 'refuted' END
 WHEN claim_type = 'distribution' THEN CASE WHEN p >= 0.05 THEN 'not_supported' WHEN k / su > ob / un AND k / su >= threshold THEN 'supported_with_caveats' ELSE 'refuted' END
 WHEN k / su >= threshold AND p < 0.05 THEN 'supported_with_caveats' WHEN k / su >= threshold THEN 'not_supported' ELSE 'refuted' END AS verdict FROM t)"""


@query("claims_batch", claim_cte() + " SELECT claim_id, verdict, violating, supporting, subject_units FROM v")
def claims_batch(spark, sf):
    return tested(spark, sf)[0].select("claim_id", "verdict", "violating", "supporting", "subject_units")


@query("claim_units", claim_cte() + " SELECT claim_id, key, CASE WHEN (claim_type = 'never_with') = (o = 1) AND claim_type <> 'distribution' THEN 'violating' WHEN claim_type = 'distribution' AND f.inside = 0 THEN 'violating' ELSE 'supporting' END AS role FROM f JOIN cl USING (claim_id) WHERE s = 1")
def claim_units(spark, sf):
    return tested(spark, sf)[1]


@query("claim_resolution", """WITH l AS (SELECT DISTINCT n_name AS term, lower(n_name) AS surface FROM nation), c AS (SELECT c_custkey AS claim_id, lower(concat('orders of ', n_name, ' with ', c_mktsegment)) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT claim_id, term, instr(concat(' ', text, ' '), concat(' ', surface, ' ')) AS "at" FROM c JOIN l ON instr(concat(' ', text, ' '), concat(' ', surface, ' ')) > 0 WHERE length(surface) > 2""")
def claim_resolution(spark, sf):
    nation = V.table(spark, sf, "nation")
    claims = V.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("claim_id"), F.concat(F.lit("orders of "), "n_name", F.lit(" with "), "c_mktsegment").alias("text"))
    return H.resolve_terms(claims, nation.select(F.lower("n_name").alias("surface"), F.col("n_name").alias("term"))).select("claim_id", "term", "at")


# -- vectors

QV = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {QV}::DOUBLE[]), 5) AS score FROM embeddings WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    v = V.table(spark, sf, "embeddings")
    q = list(v.orderBy("vec_id").select("embedding").first()[0])
    return VEC.topk(v.where("label % 2 = 0"), q, 20).select("vec_id", F.round("score", 5).alias("score"))


@query("vector_batch", "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def vector_batch(spark, sf):
    v = V.table(spark, sf, "embeddings")
    return VEC.knn_batch(v.where("vec_id % 20 = 0"), v, 10).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


# -- loading


def user_events(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@query("run_collapse", """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS v FROM events), l AS (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY user_id ORDER BY pos))::int, 1) AS nw FROM o),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM l), g AS (SELECT user_id, run, min(pos) AS start, max(pos) AS stop, any_value(v) AS text, count(*) AS length FROM r GROUP BY 1, 2)
SELECT user_id, start, stop, text, length, row_number() OVER (PARTITION BY user_id ORDER BY run) - 1 AS chunk_index FROM g""")
def run_collapse(spark, sf):
    e = user_events(spark, sf)
    numbered = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return S.collapse_runs(numbered, "user_id", "pos", "event_type").withColumnRenamed("end", "stop")


@query("range_cover", """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS v FROM events), l AS (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY user_id ORDER BY pos))::int, 1) AS nw FROM o),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM l), g AS (SELECT user_id, run, min(pos) AS a, max(pos) AS z, any_value(v) AS text FROM r GROUP BY 1, 2) SELECT user_id AS section_id, 10 AS unit_num, text FROM g WHERE 10 BETWEEN a AND z""")
def range_cover(spark, sf):
    e = user_events(spark, sf)
    numbered = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    notes = S.collapse_runs(numbered, "user_id", "pos", "event_type").select(F.col("user_id").alias("section_id"), F.col("start").alias("unit_start"), F.col("end").alias("unit_end"), F.lit("e").alias("edition"), F.lit(None).cast("int").alias("year"), "text")
    points = e.select(F.col("user_id").alias("section_id"), F.lit(10).alias("unit_num")).distinct()
    return R.covering_notes(notes, points).select("section_id", "unit_num", "text")


@query("first_record_dedupe", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def first_record_dedupe(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    out = S.first_records(pages, F.regexp_extract("url", r"^https?://([^/]+)", 1), "page_id")
    return out.select(F.col("_key").alias("host"), "page_id")


def gate(spark, sf):
    """Every fourth source is restricted, every seventh is not available."""
    number = F.substring("slug", 4, 10).cast("int")
    editions = V.table(spark, sf, "documents").select(F.col("source").alias("slug")).distinct().withColumns({"status": F.when(number % 4 == 0, "restricted").otherwise("open"), "available": number % 7 != 0})
    return V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("edition")), editions


@query("licence_gate", "SELECT doc_id, cast(substr(source, 4) AS int) % 4 <> 0 AND cast(substr(source, 4) AS int) % 7 <> 0 AS admitted FROM documents")
def licence_gate(spark, sf):
    admitted, withheld = S.licence_gate(*gate(spark, sf), ["open"])
    return admitted.select("doc_id", F.lit(True).alias("admitted")).unionByName(withheld.select("doc_id", F.lit(False).alias("admitted")))


@query("licence_audit", "SELECT source AS slug, count(*) AS rows, cast(substr(source, 4) AS int) % 4 <> 0 AND cast(substr(source, 4) AS int) % 7 <> 0 AS shipped FROM documents GROUP BY source")
def licence_audit(spark, sf):
    return S.audit_editions(*gate(spark, sf), ["open"]).drop("status")


@query("feature_parse", "SELECT l_returnflag, l_linestatus, count(*) AS n, 'P' AS tag, 'ACT' AS voice, CASE l_returnflag WHEN 'R' THEN '3' END AS person, 'S' AS number FROM lineitem GROUP BY 1, 2")
def feature_parse(spark, sf):
    line = V.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey")
    bundle = F.concat(F.lit("P|PERF|ROOT:"), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", "|3MS").otherwise("|MS"), F.lit("|CERT"))
    f = line.withColumn("f", S.parse_features(bundle))
    return f.groupBy("l_returnflag", "l_linestatus").agg(F.count("f.term").alias("n"), F.max("f.tag").alias("tag"), F.max("f.voice").alias("voice"), F.max("f.person").alias("person"), F.max("f.number").alias("number"))


@query("upsert_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0")
def upsert_merge(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("status"))
    new = o.where("o_orderkey % 50 = 0 and o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"))
    return S.upsert(o, changed.unionByName(new), ["o_orderkey"])


# The fold's state: words done, tokens passed, words aligned, the last of them.
ALIGNED = " ".join(f"WHEN array_to_string(tokens[s.past + 1:s.past + {n}], '') THEN {n}" for n in range(1, 5))


@query("word_alignment", f"""WITH d AS (SELECT doc_id AS unit_id, {V.TOKENS} AS words FROM documents),
t AS (SELECT unit_id, words, flatten(list_transform(words, lambda w, i: CASE WHEN (i - 1) % 3 = 0 AND length(w) > 3 THEN [substr(w, 1, 2), substr(w, 3)] ELSE [w] END)) AS tokens FROM d),
f AS (SELECT unit_id, list_reduce(list_transform(words, lambda w, i: {{'word': w, 'pos': cast(i AS int), 'past': 0, 'aligned': 0, 'latest': 0}}),
lambda s, x: list_transform([CASE x.word {ALIGNED} ELSE 0 END], lambda n: {{'word': '', 'pos': 0, 'past': s.past + greatest(n, 1), 'aligned': s.aligned + least(n, 1), 'latest': CASE WHEN n > 0 THEN x.pos ELSE s.latest END}})[1],
{{'word': '', 'pos': 0, 'past': 0, 'aligned': 0, 'latest': 0}}) AS s FROM t)
SELECT unit_id, cast(s.aligned AS bigint) AS aligned, s.latest AS last FROM f WHERE s.aligned > 0""")
def word_alignment(spark, sf):
    """Documents' words against their own text with every third token broken in two."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), X.words(F.col("text")).alias("words"))
    cut = F.flatten(F.transform("words", lambda w, i: F.when((i % 3 == 0) & (F.length(w) > 3), F.array(F.substring(w, 1, 2), F.substring(w, 3, 100_000))).otherwise(F.array(w))))
    return S.align_words(d, d.select("unit_id", cut.alias("tokens"), cut.alias("folded"))).groupBy("unit_id").agg(F.count("*").alias("aligned"), F.max("position").alias("last"))


# -- workspace and evidence on pages and conversations


@query("anchors", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def anchors(spark, sf):
    return W.link_anchors(V.table(spark, sf, "pages"), "page_id", F.col("html"))


@query("backlinks", """WITH a AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href, string_agg(cast(page_id AS varchar), ',' ORDER BY page_id) AS sources, count(*) AS n FROM a GROUP BY href""")
def backlinks(spark, sf):
    out = W.backlinks(W.link_anchors(V.table(spark, sf, "pages"), "page_id", F.col("html")), "href", "page_id")
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query("note_anchors", """WITH u AS (SELECT doc_id AS unit_id, cast(substr(source, 4) AS int) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, text FROM documents) SELECT DISTINCT page_id AS note_id, unit_id, substr(text, 1, 200) AS quote FROM pages JOIN u ON (s = page_id % 20 AND n = page_id % 60 + 1) OR (s = page_id % 7 AND n = 1)""")
def note_anchors(spark, sf):
    ref = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    p = F.col("page_id")
    notes = V.table(spark, sf, "pages").select(p.alias("note_id"), F.concat(F.lit("see [["), ref(p % 20, p % 60 + 1), F.lit("]] and [[99:1]]")).alias("text"), F.array(ref(p % 7, F.lit(1))).alias("refs"))
    return W.note_anchors(notes, V.units(spark, sf).select("unit_id", "section_id", "unit_num", "text"))


@query("version_chain", """WITH RECURSIVE v AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations), d AS (SELECT DISTINCT id, parent FROM v),
r AS (SELECT id, id AS root, 0 AS depth FROM d WHERE parent IS NULL OR parent NOT IN (SELECT id FROM d) UNION ALL SELECT d.id, r.root, r.depth + 1 FROM d JOIN r ON d.parent = r.id) SELECT id, root, depth FROM r""")
def version_chain(spark, sf):
    c = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id")).distinct()
    return W.version_chains(c)


def findings(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("author_id"), F.when(F.col("o_orderstatus") == "O", "in_review").otherwise("draft").alias("status"), F.col("o_orderdate").alias("created_at"))


@query("review_queue", "SELECT o_orderkey AS finding_id, o_custkey AS author_id FROM orders WHERE o_orderstatus = 'O'")
def review_queue(spark, sf):
    return W.review_queue(findings(spark, sf)).select("finding_id", "author_id")


@query("review_rejects", "SELECT o_orderkey AS finding_id, CASE WHEN o_custkey % 3 = 0 THEN 'author reviews own finding' ELSE 'not in review' END AS reason FROM orders WHERE o_custkey % 3 = 0 OR o_orderstatus <> 'O'")
def review_rejects(spark, sf):
    f = findings(spark, sf)
    reviews = f.select("finding_id", F.when(F.col("author_id") % 3 == 0, F.col("author_id")).otherwise(-1).alias("reviewer_id"), F.lit(True).alias("approve"), F.col("created_at").alias("reviewed_at"))
    return W.apply_reviews(f, reviews)[1].select("finding_id", "reason")


@query("topic_collisions", r"SELECT regexp_replace(lower(p_type), '[^\p{L}\p{N}_]+', '-', 'g') AS slug, count(DISTINCT p_brand) AS owners, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def topic_collisions(spark, sf):
    return W.topic_collisions(V.table(spark, sf, "part"), F.col("p_type"), "p_brand")


@query("prior_work", "SELECT doc_id FROM documents WHERE contains(lower(text), 'heat') OR contains(lower(text), 'lichkeit') ORDER BY doc_id DESC LIMIT 10")
def prior_work(spark, sf):
    return W.prior_work(V.table(spark, sf, "documents"), "heat of lichkeit", F.col("text"), F.col("doc_id")).select("doc_id")


def mail_citations(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select(F.when(F.col("role") == "user", "hadith").otherwise("ayah").alias("kind"), (F.col("conv_id") % 40).cast("string").alias("ref"), F.lit("e").alias("edition_slug"), (F.col("conv_id") % 40 % 5).cast("int").alias("death_year"), F.lit(None).cast("string").alias("grading"))


@query("bibliography", "SELECT CASE role WHEN 'user' THEN 'hadith' ELSE 'ayah' END AS kind, cast(conv_id % 40 AS varchar) AS ref, count(*) AS times_cited, min(conv_id % 40 % 5) AS death_year FROM conversations GROUP BY 1, 2")
def bibliography(spark, sf):
    return E.bibliography(mail_citations(spark, sf)).select("kind", "ref", "times_cited", "death_year")


@query("disagreements", "SELECT conv_id AS section_id, turn // 2 AS unit_num, string_agg(DISTINCT role, ',' ORDER BY role) AS editions FROM conversations GROUP BY 1, 2 HAVING count(DISTINCT role) > 1")
def disagreements(spark, sf):
    notes = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("section_id"), F.floor(F.col("turn") / 2).alias("unit_num"), F.col("role").alias("edition"))
    return E.disagreements(notes).select("section_id", "unit_num", F.array_join("editions", ",").alias("editions"))


@query("unverified_runs", r"""WITH d AS (SELECT conv_id AS run_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+ \p{L}+ \p{L}+')) AS run FROM conversations WHERE role <> 'user'), v AS (SELECT conv_id AS run_id, lower(text) AS t FROM conversations WHERE role = 'user')
SELECT DISTINCT run_id, run FROM d WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.run_id = d.run_id AND contains(t, lower(run)))""")
def unverified_runs(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), "role", "text")
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"(\p{Lu}\p{Ll}+ \p{L}+ \p{L}+)"), 1)
    return E.unverified_runs(c.where("role <> 'user'"), c.where("role = 'user'"), runs, F.col("text"))


@query("placeholders", "SELECT conv_id * 1000 + turn AS doc_id, count(*) AS n, max(concat('see ', CASE WHEN conv_id % 60 < (SELECT count(*) FROM benchmark) THEN (SELECT min(b.text) FROM benchmark b WHERE b.item_id = conv_id % 60) ELSE concat('[UNRESOLVED item:', conv_id % 60, ']') END, ' end')) AS text FROM conversations GROUP BY 1")
def placeholders(spark, sf):
    """Conversation turns that cite benchmark items, of which some do not exist."""
    c = V.table(spark, sf, "conversations").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), (F.col("conv_id") % 60).alias("ref")).agg(F.count("*").alias("n"))
    docs = c.select("doc_id", F.concat(F.lit("see {{item:"), F.col("ref").cast("string"), F.lit("}} end")).alias("text"))
    sources = V.table(spark, sf, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("ref"), F.lit("").alias("arg"), "text")
    return E.render_placeholders(docs, sources).select("doc_id", "text").join(c.select("doc_id", "n"), "doc_id")


@query("unsupported_claims", "SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'open' ELSE 'needs_evidence' END AS status FROM orders")
def unsupported_claims(spark, sf):
    claims = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.array(F.col("o_orderkey").cast("string")).alias("support"), F.lit(False).alias("universal"))
    spans = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("span_id")).distinct()
    return E.claim_support(claims, spans).select("claim_id", "status")


@query("golden_report", "WITH a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderpriority AS tier, count(*) AS items, sum((coalesce(n, 0) >= 4 AND n IS NOT NULL)::int) AS passed FROM orders LEFT JOIN a ON id = o_orderkey GROUP BY 1")
def golden_report(spark, sf):
    none = F.lit(None).cast("array<string>")
    expected = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("tier"), F.lit("min_value").alias("kind"), F.lit("4").alias("value"), none.alias("items"))
    actual = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.count("*").cast("string").alias("value")).withColumns({"items": none, "sample_complete": F.lit(True)})
    return E.golden_summary(E.golden_report(expected, actual))


@query("run_summary", "SELECT o_custkey AS run_id, count(*) AS claims, sum((o_orderstatus = 'O')::int) AS open, sum((o_orderstatus = 'F')::int) AS verified FROM orders GROUP BY 1")
def run_summary(spark, sf):
    c = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "verified").otherwise("other").alias("status"))
    return E.run_summary(c).select("run_id", "claims", "open", "verified")


# -- telemetry


def spans(spark, sf):
    return user_events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("ts").alias("started_at"), F.when(F.col("event_type") != "click", F.col("value")).alias("duration_ms"), F.when(F.col("event_type") == "error", "error").alias("error"))


@query("trace_rollup", "SELECT user_id AS run_id, count(*) AS spans, epoch_us(min(ts)) AS started_us, round(sum(CASE WHEN event_type <> 'click' THEN coalesce(value, 0) ELSE 0 END), 3) AS duration_ms, sum((event_type = 'error')::int) AS errors, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1")
def trace_rollup(spark, sf):
    out = M.trace_rollup(spans(spark, sf))
    return out.select("run_id", "spans", F.unix_micros("started_at").alias("started_us"), F.round("duration_ms", 3).alias("duration_ms"), "errors", F.array_join("names", ",").alias("names"))


@query("job_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1")
def job_state(spark, sf):
    out = M.job_states(user_events(spark, sf), "user_id", "event_type", "ts", "event_id")
    return out.select("user_id", "status", F.unix_micros("at").alias("at_us"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


def drained(frame: DataFrame, name: str) -> DataFrame:
    """All that a stream gives until its input ends, from the files its sink wrote."""
    import uuid

    base = f"{shared_folder(frame.sparkSession).rstrip('/')}/verbatlas/{name}-{uuid.uuid4().hex}"
    frame.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{base}/out")


@query("stream_rollup", """WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM events)
SELECT epoch_ms(d) AS window_ms, event_type, count(*) AS spans, round(sum(value), 3) AS total FROM e, m WHERE d + INTERVAL 1 DAY <= date_trunc('milliseconds', w) GROUP BY 1, 2""")
def stream_rollup(spark, sf):
    """Windows that the watermark has closed; open ones wait for more events."""
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(M.stream_rollup(stream, ["event_type"], "ts", value=F.col("value")), "rollup")
    return out.select(F.unix_millis("window_start").alias("window_ms"), "event_type", "spans", F.round("total", 3).alias("total"))


@query("stream_index", f"WITH {V.U}, {V.W} SELECT term, count(DISTINCT unit_id) AS df FROM w WHERE length(term) <= 64 GROUP BY term")
def stream_index(spark, sf):
    import uuid

    base = f"{shared_folder(spark).rstrip('/')}/verbatlas/index-{uuid.uuid4().hex}"
    schema = V.table(spark, sf, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet*")
    M.upkeep(docs, X.words(F.col("text")), f"{base}/index", f"{base}/state").awaitTermination()
    return M.read_index(spark, f"{base}/index")[2]

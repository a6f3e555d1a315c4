"""Registered queries over the text corpus, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.functions.stats import assess, correct_multiple
from verbatlas.operators import conditionals as Q
from verbatlas.operators import derive as D
from verbatlas.operators import distribution as B
from verbatlas.operators import evidence as E
from verbatlas.operators import graph as G
from verbatlas.operators import lexical as L
from verbatlas.operators import passages as N
from verbatlas.operators import retrieval as R
from verbatlas.operators.term_index import TermIndex
from verbatlas.plans import views as V
from verbatlas.plans.registry import query
from verbatlas.sources.shared import shared_folder

T1 = f"WITH {V.U}, {V.W} "


def occ(spark: SparkSession, sf: str) -> DataFrame:
    return V.occurrences(V.plain_units(spark, sf))


def full_occ(spark: SparkSession, sf: str) -> DataFrame:
    return V.occurrences(V.units(spark, sf))


def joined(array: str) -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# -- terms


@query("term_totals", T1 + "SELECT count(*) AS total, count(DISTINCT unit_id) AS units FROM w WHERE term = 'the'")
def term_totals(spark, sf):
    return R.totals(occ(spark, sf).where(F.col("term") == "the"))


@query("term_by_section", T1 + "SELECT section_id, count(*) AS total, count(DISTINCT unit_id) AS units FROM w WHERE term = 'the' GROUP BY section_id")
def term_by_section(spark, sf):
    return R.by(occ(spark, sf).where(F.col("term") == "the"), "section_id")


@query("term_by_cohort", T1 + "SELECT cohort, count(*) AS total, count(DISTINCT unit_id) AS units FROM w WHERE term = 'de' GROUP BY cohort")
def term_by_cohort(spark, sf):
    return R.by(occ(spark, sf).where(F.col("term") == "de"), "cohort")


@query("term_hits_page", T1 + "SELECT unit_id, position, section_id FROM w WHERE term = 'is' AND section_id NOT IN (3) ORDER BY unit_id, position LIMIT 50 OFFSET 20")
def term_hits_page(spark, sf):
    return R.page(R.CorpusFilter(not_sections=[3]).apply(occ(spark, sf)).where(F.col("term") == "is"), limit=50, offset=20).select("unit_id", "position", "section_id")


@query("term_hits_merged", T1 + "SELECT unit_id, array_to_string(list_sort(list_distinct(list(position))), ',') AS positions, count(*) AS matches FROM w WHERE term = 'und' GROUP BY unit_id")
def term_hits_merged(spark, sf):
    return R.merged(occ(spark, sf).where(F.col("term") == "und")).withColumn("positions", joined("positions"))


@query("term_counts", T1 + "SELECT term, count(*) AS occurrences, count(DISTINCT unit_id) AS units FROM w GROUP BY term")
def term_counts(spark, sf):
    return D.term_counts(occ(spark, sf).select("unit_id", "term"))


# -- phrases


@query("phrase_exact", f"WITH {V.U} SELECT unit_id, 'exact' AS tier, cast((length(t) - length(replace(t, 'of the', ''))) / 6 AS int) AS occurrences FROM (SELECT unit_id, lower(text) AS t FROM u) WHERE contains(t, 'of the')")
def phrase_exact(spark, sf):
    lower = F.lower(F.col("text"))
    return R.phrase_search(V.plain_units(spark, sf), "of the", lower, F.regexp_replace(lower, "[aeiou]", ""), F.lit("of the"), F.lit("f th")).select("unit_id", "tier", "occurrences")


@query("phrase_fallback", f"WITH {V.U} SELECT unit_id, 'loose' AS tier, cast((length(t) - length(replace(t, 'thrnd', ''))) / 5 AS int) AS occurrences FROM (SELECT unit_id, regexp_replace(lower(text), '[aeiou]', '', 'g') AS t FROM u) WHERE contains(t, 'thrnd')")
def phrase_fallback(spark, sf):
    lower = F.lower(F.col("text"))
    return R.phrase_search(V.plain_units(spark, sf), "theeeernd", lower, F.regexp_replace(lower, "[aeiou]", ""), F.lit("theeeernd"), F.lit("thrnd")).select("unit_id", "tier", "occurrences")


@query("phrase_positions", T1 + "SELECT a.unit_id, array_to_string(list_sort(list_distinct(flatten(list([a.position, a.position + 1])))), ',') AS positions FROM w a JOIN w b ON a.unit_id = b.unit_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.unit_id")
def phrase_positions(spark, sf):
    out = V.plain_units(spark, sf).select("unit_id", X.positions_of(X.words(F.col("text")), F.array(F.lit("of"), F.lit("the"))).alias("positions"))
    return out.where(F.size("positions") > 0).withColumn("positions", joined("positions"))


# -- units


@query("unit_range", f"WITH {V.U} SELECT unit_id, unit_num, n_words FROM u WHERE section_id = 4 AND unit_num BETWEEN 5 AND 14")
def unit_range(spark, sf):
    return R.unit_range(V.units(spark, sf), 4, 5, 14).select("unit_id", "unit_num", "n_words")


@query("corpus_totals", f"WITH {V.U} SELECT count(*) AS units, count(DISTINCT section_id) AS sections, sum(n_words) AS words, max(n_words) AS longest FROM u")
def corpus_totals(spark, sf):
    return R.corpus_totals(V.plain_units(spark, sf)).drop("complete")


@query("text_measures", rf"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g')[1:120] AS slug, len(regexp_extract_all(text, '\p{{L}}')) AS letters, CASE WHEN length(text) > 120 THEN concat(substr(text, 1, 120), '…') ELSE text END AS summary FROM documents")
def text_measures(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", X.slug(t).alias("slug"), X.letter_count(t).alias("letters"), X.payload_summary(t).alias("summary"))


@query("text_folding", r"""SELECT p_partkey, regexp_replace(translate(regexp_replace(translate(regexp_replace(regexp_replace(translate(trim(p_name), '''|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYy{', 'ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيٱ'), '[^\x{0600}-\x{06FF}]', '', 'g'), '[\s\-\x{2010}-\x{2015}_.,/]+', '', 'g'), '', ''), '[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08D3}-\x{08FF}\x{0640}]', '', 'g'), 'آأإٱىةؤئکیھء', 'اااايهويكيها'), 'zzz', '') AS key FROM part""")
def text_folding(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", X.term_key(F.col("p_name")).alias("key"))


# -- ranked retrieval

BM = """, pp AS (SELECT unit_id AS doc_id, term, count(*) AS tf FROM w WHERE length(term) <= 64 GROUP BY 1, 2), dl AS (SELECT unit_id AS doc_id, n_words AS length FROM u),
st AS (SELECT count(*) AS n, avg(length) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM pp GROUP BY 1)"""
BS = "greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))"


def index(spark, sf):
    return L.build_index(V.plain_units(spark, sf).select(F.col("unit_id").alias("doc_id"), "text"), X.words(F.col("text")))


def queries_from_benchmark(spark, sf):
    """The words of every benchmark item, as one query each."""
    return V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("terms"))


@query("bm25_terms", T1 + BM + f" SELECT doc_id, term, tf, df, round({BS}, 6) AS score FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('heat', 'und', 'leaux')")
def bm25_terms(spark, sf):
    q = spark.range(1).select(F.col("id").alias("query_id"), F.array(F.lit("heat"), F.lit("und"), F.lit("leaux"), F.lit("und")).alias("terms"))
    return L.bm25_terms(q, *index(spark, sf)).select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"))


@query("bm25_topk", T1 + BM + f" SELECT doc_id, round(sum({BS}), 6) AS score, array_to_string(list_sort(list(term)), ',') AS terms FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('heat', 'und', 'la') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    scores = L.bm25_topk(["heat", "und", "la"], *index(spark, sf), k=20)
    return scores.select("doc_id", F.round("score", 6).alias("score"), joined("terms").alias("terms"))


@query("bm25_explain", T1 + BM + f" SELECT term, tf, df, round(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0), 6) AS idf, round({BS}, 6) AS score FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE doc_id = 7 AND term IN ('the', 'of', 'is')")
def bm25_explain(spark, sf):
    q = spark.range(1).select(F.col("id").alias("query_id"), F.array(F.lit("the"), F.lit("of"), F.lit("is")).alias("terms"))
    return L.bm25_terms(q, *index(spark, sf)).where("doc_id = 7").select("term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


@query("bm25_batch", T1 + BM + f""", q AS (SELECT DISTINCT item_id AS query_id, unnest({V.TOKENS}) AS term FROM benchmark), s AS (SELECT query_id, doc_id, sum({BS}) AS score FROM q JOIN pp USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) SELECT query_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 3""")
def bm25_batch(spark, sf):
    terms = L.bm25_scores(queries_from_benchmark(spark, sf), *index(spark, sf)).withColumn("score", F.round("score", 6))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return terms.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


# -- the stored index: documents come in batches, are merged in part, and searched without their texts

_INDEXES: dict[tuple[str, str], TermIndex] = {}


def stored_index(spark, sf):
    """Documents as of ``kind`` text and benchmark items as of ``kind`` item, in three batches, the first two of which are merged; built once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        made = TermIndex(spark, f"{shared_folder(spark).rstrip('/')}/verbatlas/index-{uuid.uuid4().hex}")
        docs = V.table(spark, sf, "documents").select("doc_id", "lang", "text")
        words = X.words(F.col("text"))
        made.add(0, docs.where("lang = 'en'"), words)
        made.add_kinds(1, {"text": (docs.where("lang <> 'en'"), words, "doc_id"), "item": (V.table(spark, sf, "benchmark"), words, "item_id")})
        made.compact()
        made.vacuum()
        made.add(2, docs.where("lang IS NULL"), words)
        _INDEXES[key] = made
    return _INDEXES[key]


@query("index_topk", T1 + BM + f" SELECT doc_id, round(sum({BS}), 6) AS score, array_to_string(list_sort(list(term)), ',') AS terms FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('heat', 'und', 'la') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def index_topk(spark, sf):
    """``bm25_topk`` from the stored index."""
    scores = stored_index(spark, sf).topk(["heat", "und", "la"], 20, ["text"])
    return scores.select("doc_id", F.round("score", 6).alias("score"), joined("terms").alias("terms"))


@query("index_batch", T1 + BM + f""", q AS (SELECT DISTINCT item_id AS query_id, unnest({V.TOKENS}) AS term FROM benchmark), s AS (SELECT query_id, doc_id, sum({BS}) AS score FROM q JOIN pp USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) SELECT query_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 3""")
def index_batch(spark, sf):
    """The three best documents of every benchmark item from the stored index."""
    scores = stored_index(spark, sf).scores(queries_from_benchmark(spark, sf), ["text"]).withColumn("score", F.round("score", 6))
    return L.best_documents(scores, 3, "kind", "doc_id").select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


@query("index_terms", f"WITH a AS (SELECT doc_id, {V.TOKENS} AS t FROM documents UNION ALL SELECT item_id, {V.TOKENS} FROM benchmark), p AS (SELECT unnest(list_distinct(t)) AS term FROM a) SELECT term, count(*) AS df FROM p WHERE length(term) <= 64 GROUP BY term")
def index_terms(spark, sf):
    """The dictionary over both kinds, summed over batches and the compaction."""
    return stored_index(spark, sf).document_counts()


@query("index_phrase", T1 + "SELECT a.unit_id, count(*) AS occurrences, array_to_string(list_sort(list_distinct(flatten(list([a.position, a.position + 1])))), ',') AS positions FROM w a JOIN w b ON a.unit_id = b.unit_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.unit_id")
def index_phrase(spark, sf):
    """Where a phrase stands, from lists of positions; no text is read."""
    found = stored_index(spark, sf).phrase(["of", "the"], ["text"])
    return found.select(F.col("doc_id").alias("unit_id"), "occurrences", joined("positions").alias("positions"))


@query("index_phrases", f"""WITH d AS (SELECT doc_id, {V.TOKENS} AS t FROM documents), i AS (SELECT item_id, {V.TOKENS} AS t FROM benchmark), q AS (SELECT DISTINCT unnest(list_transform(generate_series(1, len(t) - 3), lambda k: array_to_string(t[k:k+3], ' '))) AS phrase FROM i WHERE len(t) >= 4),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 3), lambda k: array_to_string(t[k:k+3], ' '))) AS phrase FROM d WHERE len(t) >= 4)
SELECT phrase, doc_id, count(*) AS occurrences FROM g JOIN q USING (phrase) GROUP BY 1, 2""")
def index_phrases(spark, sf):
    """Every run of four words of every benchmark item, looked up in all documents at once."""
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - 3), lambda k: F.slice("t", k, 4))
    items = V.table(spark, sf, "benchmark").select(X.words(F.col("text")).alias("t")).where("size(t) >= 4").select(F.explode(runs).alias("terms")).distinct()
    return stored_index(spark, sf).phrases(items.select(F.array_join("terms", " ").alias("phrase_id"), "terms"), ["text"]).select(F.col("phrase_id").alias("phrase"), "doc_id", "occurrences")


# -- derived edges

SH = """, t AS (SELECT unit_id, list_distinct(list_transform(generate_series(1, len(tokens) - 2), lambda i: array_to_string(tokens[i:i+2], ' '))) AS s FROM u WHERE len(tokens) >= 4),
g AS (SELECT unit_id, unnest(s) AS item, len(s) AS n FROM t), p AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS shared, max(x.n) AS na, max(y.n) AS nb FROM g x JOIN g y ON x.item = y.item AND x.unit_id < y.unit_id GROUP BY 1, 2),
e AS (SELECT a, b, shared, shared / (na + nb - shared) AS score FROM p WHERE shared / (na + nb - shared) >= 0.6)"""


def dup_pairs(spark, sf):
    return D.similar_packed(D.shingle_sets(V.plain_units(spark, sf).select("unit_id", "text"), X.words(F.col("text")), 3, 4), 0.6)


def dup_groups(spark, sf):
    return D.duplicate_groups(V.plain_units(spark, sf).select("unit_id", "text"), X.words(F.col("text")))


@query("near_duplicates", f"WITH {V.U}" + SH + """, f AS (SELECT a, b, shared, score FROM e UNION ALL SELECT b, a, shared, score FROM e)
SELECT a, b, shared, round(score, 6) AS score, array_to_string(list_filter(x.tokens, lambda q: NOT list_contains(y.tokens, q))[1:12], ' ') AS only_a, array_to_string(list_filter(y.tokens, lambda q: NOT list_contains(x.tokens, q))[1:12], ' ') AS only_b, x.tokens = y.tokens AS identical
FROM f JOIN u x ON a = x.unit_id JOIN u y ON b = y.unit_id""")
def near_duplicates(spark, sf):
    """All pairs of near duplicates with their word differences, copies with one another too."""
    out = D.near_duplicates(V.plain_units(spark, sf).select("unit_id", "text"), X.words(F.col("text")), expand=True)
    return out.select("a", "b", "shared", F.round("score", 6).alias("score"), F.array_join("only_a", " ").alias("only_a"), F.array_join("only_b", " ").alias("only_b"), "identical")


@query("dup_summary", f"WITH {V.U}" + SH + " SELECT count(*) AS pairs, coalesce(sum((score = 1)::int), 0) AS identical, round(avg(score), 6) AS mean_score, count(DISTINCT a) AS units FROM e")
def dup_summary(spark, sf):
    return D.group_summary(*dup_groups(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query("dup_clusters", f"WITH RECURSIVE {V.U}" + SH + """, s AS (SELECT a, b FROM e WHERE score >= 0.75 UNION SELECT b, a FROM e WHERE score >= 0.75),
r AS (SELECT a AS x, a AS y FROM s UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a), c AS (SELECT x AS unit_id, min(y) AS cluster FROM r GROUP BY x)
SELECT unit_id, cluster, size FROM c JOIN (SELECT cluster, count(*) AS size FROM c GROUP BY cluster HAVING count(*) >= 3) USING (cluster)""")
def dup_clusters(spark, sf):
    return D.group_clusters(*dup_groups(spark, sf))


@query("dup_links", f"WITH {V.U}" + SH + ", k AS (SELECT unit_id, list_sort(s) AS k FROM t), m AS (SELECT k, min(unit_id) AS rep FROM k GROUP BY k), n AS (SELECT rep FROM m) SELECT a, b, shared, round(score, 6) AS score FROM e WHERE a IN (SELECT rep FROM n) AND b IN (SELECT rep FROM n)")
def dup_links(spark, sf):
    """Near duplicates between representatives of equal texts; ``dup_membership`` has the copies."""
    return dup_groups(spark, sf)[1].select("a", "b", "shared", F.round("score", 6).alias("score"))


@query("dup_membership", f"WITH {V.U}" + SH + ", k AS (SELECT unit_id, list_sort(s) AS k FROM t) SELECT unit_id, min(unit_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM k")
def dup_membership(spark, sf):
    return dup_groups(spark, sf)[0].select(F.col("key").alias("unit_id"), "rep", "copies")


def dup_word_diffs(spark, sf):
    """Word diffs between representatives of equal texts; ``dup_membership`` has the copies."""
    words = V.plain_units(spark, sf).select("unit_id", X.words(F.col("text")).alias("words"))
    pairs = dup_groups(spark, sf)[1].select("a", "b", "score").join(words.select(F.col("unit_id").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("unit_id").alias("b"), F.col("words").alias("words_b")), "b")
    return D.word_diffs(pairs)


@query("dup_diff")
def dup_diff(spark, sf):
    return dup_word_diffs(spark, sf).select("a", "b", F.size("opcodes").alias("changes"), F.to_json("opcodes").alias("opcodes"))


# The longest common subsequence word by word: v is its length for the first i words of one text and the first j of the other.
@query("dup_edits", f"WITH RECURSIVE {V.U}" + SH + """, k AS (SELECT unit_id, list_sort(s) AS k FROM t), n AS (SELECT min(unit_id) AS rep FROM k GROUP BY k),
x AS (SELECT a, b, p.tokens AS l, q.tokens AS r FROM e JOIN u p ON a = p.unit_id JOIN u q ON b = q.unit_id WHERE a IN (SELECT rep FROM n) AND b IN (SELECT rep FROM n)),
la AS (SELECT a, b, generate_subscripts(l, 1) AS i, hash(unnest(l)) AS word FROM x),
s(a, b, i, j, word, v) AS (SELECT a, b, cast(0 AS bigint), generate_subscripts(r, 1), hash(unnest(r)), cast(0 AS bigint) FROM x UNION ALL
SELECT a, b, i, j, word, max(v) OVER (PARTITION BY a, b ORDER BY j) FROM (SELECT s.a, s.b, la.i, s.j, s.word, greatest(s.v, CASE WHEN s.word = la.word THEN coalesce(lag(s.v) OVER (PARTITION BY s.a, s.b ORDER BY s.j), 0) + 1 ELSE 0 END) AS v FROM s JOIN la ON s.a = la.a AND s.b = la.b AND la.i = s.i + 1))
SELECT x.a, x.b, v AS common, len(l) + len(r) - 2 * v AS edits FROM s JOIN x ON s.a = x.a AND s.b = x.b AND s.i = len(l) AND s.j = len(r)""")
def dup_edits(spark, sf):
    return dup_word_diffs(spark, sf).select("a", "b", "common", "edits")


@query("content_parallels", T1 + """, c AS (SELECT DISTINCT unit_id, term FROM w WHERE term IN (SELECT term FROM w GROUP BY term HAVING count(*) <= 400)), z AS (SELECT unit_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS shared FROM c x JOIN c y ON x.term = y.term AND x.unit_id < y.unit_id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS score FROM p JOIN z x ON a = x.unit_id JOIN z y ON b = y.unit_id WHERE shared >= 5 AND shared / (x.n + y.n - shared) >= 0.5""")
def content_parallels(spark, sf):
    return D.content_parallels(occ(spark, sf).select("unit_id", "term")).select("a", "b", "shared", F.round("score", 6).alias("score"))


@query("quote_links", f"""WITH d AS (SELECT doc_id, {V.TOKENS} AS t FROM documents), i AS (SELECT item_id, {V.TOKENS} AS t FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(t) - 4), lambda k: array_to_string(t[k:k+4], ' '))) AS gram FROM d WHERE len(t) >= 5),
ig AS (SELECT item_id, generate_subscripts(l, 1) AS pos, unnest(l) AS gram FROM (SELECT item_id, list_transform(generate_series(1, len(t) - 4), lambda k: array_to_string(t[k:k+4], ' ')) AS l FROM i WHERE len(t) >= 5))
SELECT doc_id, item_id, count(DISTINCT pos) AS matched_runs, max_by(gram, pos) AS evidence FROM dg JOIN ig USING (gram) GROUP BY 1, 2""")
def quote_links(spark, sf):
    return D.quote_links(V.table(spark, sf, "documents"), X.words(F.col("text")), V.table(spark, sf, "benchmark"), X.words(F.col("text")), 5, "doc_id", "item_id").withColumnRenamed("unit_id", "item_id")


# -- conditionals: markers are configured words; words in -ed and -ing count as verbs

COND, RSLT = ("that", "que", "als"), ("and", "et", "und")
CSQL = T1 + """, m AS (SELECT unit_id, section_id, cohort, position, term, CASE WHEN term IN ('that', 'que', 'als') THEN 'COND' WHEN term IN ('and', 'et', 'und') THEN 'RSLT' END AS tag, (term LIKE '%ed' OR term LIKE '%ing') AS verb FROM w),
sp AS (SELECT unit_id, cohort, position AS start, term AS form, coalesce(lead(position) OVER (PARTITION BY unit_id ORDER BY position), last + 1) AS stop FROM m JOIN (SELECT unit_id, max(position) AS last FROM m GROUP BY 1) USING (unit_id) WHERE tag = 'COND'),
x AS (SELECT sp.unit_id, sp.cohort, start, stop, form, min(position) FILTER (WHERE position > start AND tag = 'RSLT') AS res, list_sort(list(position) FILTER (WHERE position > start AND verb))[2] AS v2 FROM sp JOIN m ON sp.unit_id = m.unit_id AND position >= start AND position < stop GROUP BY ALL),
s AS (SELECT *, coalesce(res, v2) AS split FROM x WHERE coalesce(res, v2) IS NOT NULL),
c AS (SELECT s.unit_id, s.cohort, CASE form WHEN 'que' THEN 'that' ELSE form END AS particle, start AS word_start, stop - 1 AS word_end, CASE WHEN res IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence,
 string_agg(m.term, ' ' ORDER BY position) FILTER (WHERE position < split) AS condition, string_agg(m.term, ' ' ORDER BY position) FILTER (WHERE position >= split) AS consequence,
 list_sort(list_distinct(list(m.term) FILTER (WHERE position < split))) AS ct, list_sort(list_distinct(list(m.term) FILTER (WHERE position >= split))) AS rt
 FROM s JOIN m ON s.unit_id = m.unit_id AND position >= start AND position < stop GROUP BY s.unit_id, s.cohort, form, start, stop, res)"""


def structures(spark, sf):
    return D.conditionals_within(V.plain_units(spark, sf), X.words(F.col("text")), COND, RSLT, "(ed|ing)$", {"que": "that"}, ["cohort"])


@query("conditionals", CSQL + " SELECT unit_id, particle, word_start, word_end, confidence, md5(condition) AS condition, md5(consequence) AS consequence, len(ct) AS n_ct, len(rt) AS n_rt FROM c")
def conditionals(spark, sf):
    return structures(spark, sf).select("unit_id", "particle", "word_start", "word_end", "confidence", F.md5("condition").alias("condition"), F.md5("consequence").alias("consequence"), F.size("condition_terms").alias("n_ct"), F.size("consequence_terms").alias("n_rt"))


@query("conditional_find", CSQL + " SELECT unit_id, word_start, confidence FROM c WHERE list_has_any(ct, ['heat', 'heti']) AND cohort = 'A' AND confidence >= 0.9")
def conditional_find(spark, sf):
    return Q.find(structures(spark, sf), ["heat", "heti"], "condition", cohort="A", least=0.9).select("unit_id", "word_start", "confidence")


@query("conditional_pairs", CSQL + ", e AS (SELECT unit_id, unnest(ct) AS condition_term, rt FROM c), f AS (SELECT unit_id, condition_term, unnest(rt) AS consequence_term FROM e) SELECT condition_term, consequence_term, count(*) AS total FROM f WHERE condition_term <> consequence_term GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY total DESC, 1, 2 LIMIT 40")
def conditional_pairs(spark, sf):
    return Q.term_patterns(structures(spark, sf)).drop("examples")


@query("particle_summary", CSQL + " SELECT particle, count(*) AS total, sum((confidence >= 0.9)::int) AS explicit, count(DISTINCT unit_id) AS units FROM c GROUP BY particle")
def particle_summary(spark, sf):
    return Q.particle_summary(structures(spark, sf))


# -- distribution


@query("profile", f"WITH {V.U} SELECT cohort, count(*) AS units, sum(n_words) AS words FROM u GROUP BY ROLLUP (cohort)")
def profile(spark, sf):
    return B.corpus_profile(V.plain_units(spark, sf).select("cohort", "n_words")).drop("is_total")


@query("section_series", T1 + ", s AS (SELECT section_id, ordinal, sum(n_words) AS words FROM u GROUP BY 1, 2), c AS (SELECT section_id, count(*) AS total FROM w WHERE term = 'heat' GROUP BY 1) SELECT section_id, ordinal, words, coalesce(total, 0) AS total, round(coalesce(total, 0) * 1000.0 / greatest(words, 1), 6) AS rate FROM s LEFT JOIN c USING (section_id)")
def section_series(spark, sf):
    out = B.section_series(occ(spark, sf), V.plain_units(spark, sf), "heat")
    return out.select("section_id", "ordinal", "words", "total", F.round("rate", 6).alias("rate"))


@query("timeline", T1 + """, s AS (SELECT section_id, ordinal, sum(n_words) AS words FROM u GROUP BY 1, 2), k AS (SELECT *, cast((row_number() OVER (ORDER BY ordinal) - 1) // greatest(1, count(*) OVER () // 6) + 1 AS int) AS bucket FROM s),
bw AS (SELECT bucket, sum(words) AS words FROM k GROUP BY 1), c AS (SELECT bucket, term, count(*) AS total FROM w JOIN k USING (section_id) WHERE term IN ('heat', 'und') GROUP BY 1, 2)
SELECT bucket, term, words, coalesce(total, 0) AS total, round(coalesce(total, 0) * 1000.0 / greatest(words, 1), 6) AS rate FROM bw CROSS JOIN (VALUES ('heat'), ('und')) v(term) LEFT JOIN c USING (bucket, term)""")
def timeline(spark, sf):
    out = B.timeline(occ(spark, sf), V.plain_units(spark, sf), ["heat", "und"], 6)
    return out.select("bucket", "term", "words", "total", F.round("rate", 6).alias("rate"))


def sweep(least: int) -> str:
    """SQL up to ``tails``: every term with so many occurrences against the cohort's share of words."""
    return T1 + f""", sh AS (SELECT sum(CASE WHEN cohort = 'A' THEN n_words ELSE 0 END) / sum(n_words) AS rate FROM u), c AS (SELECT term, count(*) AS n, sum((cohort = 'A')::int) AS k, any_value(rate) AS rate FROM w, sh GROUP BY 1 HAVING count(*) >= {least}), {V.tails('c', 'term')}"""


SWEPT = sweep(20) + """, r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS rank, count(*) OVER () AS m FROM tails),
a AS (SELECT term, n, k, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cp FROM r) SELECT term, n, k AS observed, round(cp, 6) AS corrected_p FROM a"""


@query("cohort_sweep", SWEPT + " WHERE cp < 0.05")
def cohort_sweep(spark, sf):
    """The terms with 20 occurrences and more that a cohort uses more or less than chance would."""
    out = B.cohort_sweep(occ(spark, sf).select("term", "cohort"), V.plain_units(spark, sf), "A", top=None)
    return out.select("term", "n", "observed", F.round("corrected_p", 6).alias("corrected_p"))


@query("cohort_sweep_all", SWEPT)
def cohort_sweep_all(spark, sf):
    """Every term of the sweep, those within chance too."""
    out = B.cohort_sweep(occ(spark, sf).select("term", "cohort"), V.plain_units(spark, sf), "A", top=None, survivors=False)
    return out.select("term", "n", "observed", F.round("corrected_p", 6).alias("corrected_p"))


# -- graph


def concept_rows(spark, sf):
    """Concepts from the benchmark: each item's words of seven letters and more."""
    return V.table(spark, sf, "benchmark").select(F.concat(F.lit("c"), F.col("item_id")).alias("slug"), F.array_distinct(F.filter(X.words(F.col("text")), lambda x: F.length(x) >= 7)).alias("terms"))


CU = T1 + f", cc AS (SELECT DISTINCT concat('c', item_id) AS slug, unnest(list_filter({V.TOKENS}, lambda x: length(x) >= 7)) AS term FROM benchmark), cu AS (SELECT slug, unit_id, count(*) AS weight FROM w JOIN cc USING (term) GROUP BY 1, 2)"


def concept_units(spark, sf):
    return D.seed_concepts(concept_rows(spark, sf), occ(spark, sf).select("unit_id", "term"))[2]


@query("concept_units", CU + " SELECT slug, unit_id, weight FROM cu")
def concept_units_query(spark, sf):
    return concept_units(spark, sf)


@query("concept_unresolved", CU + " SELECT slug, term FROM cc WHERE term NOT IN (SELECT term FROM w)")
def concept_unresolved(spark, sf):
    return D.seed_concepts(concept_rows(spark, sf), occ(spark, sf).select("unit_id", "term"))[1]


@query("concept_expansion", CU + " SELECT slug, unit_id, weight, (SELECT count(*) FROM cu WHERE slug = 'c1') AS total_units FROM cu WHERE slug = 'c1' ORDER BY weight DESC, unit_id LIMIT 100")
def concept_expansion(spark, sf):
    return G.concept_expansion(concept_units(spark, sf), "c1")


@query("concept_map", CU + ", e AS (SELECT x.slug AS a, y.slug AS b, count(*) AS shared FROM (SELECT DISTINCT slug, unit_id FROM cu) x JOIN (SELECT DISTINCT slug, unit_id FROM cu) y ON x.unit_id = y.unit_id AND x.slug < y.slug GROUP BY 1, 2 HAVING count(*) >= 3) SELECT slug, sum(shared) AS degree FROM (SELECT a AS slug, shared FROM e UNION ALL SELECT b, shared FROM e) GROUP BY 1")
def concept_map(spark, sf):
    return G.concept_map(concept_units(spark, sf))[1]


@query("concept_distribution", CU + f", sh AS (SELECT sum((cohort = 'A')::int) / count(*) AS rate FROM u), c AS (SELECT count(*) AS n, sum((cohort = 'A')::int) AS k FROM u WHERE unit_id IN (SELECT unit_id FROM cu WHERE slug = 'c2')) SELECT k AS observed, n, round({V.p_value('k', 'n', 'rate')}, 6) AS p_value FROM c, sh")
def concept_distribution(spark, sf):
    out = B.concept_distribution(concept_units(spark, sf), V.plain_units(spark, sf), "c2", "A")
    return out.select("observed", "n", F.round("sig.p_value", 6).alias("p_value"))


@query("term_bridges", T1 + """, f AS (SELECT 'unit' AS level, cast(unit_id AS varchar) AS k, max((term = 'heat')::int) AS a, max((term = 'heti')::int) AS b FROM w WHERE term IN ('heat', 'heti') GROUP BY 1, 2
UNION ALL SELECT 'block', concat(section_id, ':', block_id), max((term = 'heat')::int), max((term = 'heti')::int) FROM w WHERE term IN ('heat', 'heti') GROUP BY 1, 2
UNION ALL SELECT 'section', cast(section_id AS varchar), max((term = 'heat')::int), max((term = 'heti')::int) FROM w WHERE term IN ('heat', 'heti') GROUP BY 1, 2) SELECT level, sum(a * b) AS both, sum(a * (1 - b)) AS only_a, sum(b * (1 - a)) AS only_b FROM f GROUP BY level""")
def term_bridges(spark, sf):
    return G.bridges(full_occ(spark, sf), "heat", "heti", {"unit": ["unit_id"], "block": ["section_id", "block_id"], "section": ["section_id"]})


@query("term_neighbours", T1 + "SELECT term, count(DISTINCT unit_id) AS shared FROM w WHERE term <> 'heat' AND unit_id IN (SELECT unit_id FROM w WHERE term = 'heat') GROUP BY term ORDER BY shared DESC, term LIMIT 20")
def term_neighbours(spark, sf):
    return G.term_neighbours(occ(spark, sf).select("unit_id", "term"), "heat")


@query("section_top_terms", T1 + ", c AS (SELECT section_id, term, count(*) AS total FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY total DESC, term) AS rank FROM c) SELECT section_id, term, total, rank FROM r WHERE rank <= 30")
def section_top_terms(spark, sf):
    return G.section_top_terms(occ(spark, sf).select("section_id", "term"))


@query("cooccurring_units", T1 + "SELECT DISTINCT unit_id FROM w WHERE term = 'heat' AND unit_id IN (SELECT unit_id FROM w WHERE term = 'heti')")
def cooccurring_units(spark, sf):
    return G.cooccurring_units(occ(spark, sf).select("unit_id", "term"), "heat", "heti")


@query("neighbourhood", f"WITH {V.U}" + SH + f""", {V.W}, s AS (SELECT unit_id AS src FROM u WHERE unit_id % 20 = 0), ed AS (SELECT a AS src, 'similar' AS kind, cast(b AS varchar) AS dst, score AS weight FROM e UNION ALL SELECT b, 'similar', cast(a AS varchar), score FROM e
UNION ALL SELECT unit_id, 'term', term, count(*) FROM w GROUP BY 1, 3), r AS (SELECT ed.*, row_number() OVER (PARTITION BY src, kind ORDER BY weight DESC, dst) AS rank FROM ed SEMI JOIN s ON ed.src = s.src) SELECT src, kind, dst, round(weight, 6) AS weight, rank FROM r WHERE rank <= 5""")
def neighbourhood(spark, sf):
    e = dup_pairs(spark, sf)
    both = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("score").alias("weight")))
    terms = occ(spark, sf).groupBy(F.col("unit_id").alias("src"), F.col("term").alias("dst")).agg(F.count("*").alias("weight"))
    sources = V.table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("src"))
    return G.neighbourhood({"similar": both, "term": terms}, sources, 5).withColumn("weight", F.round("weight", 6))


@query("neighbourhood_depth", f"WITH RECURSIVE {V.U}" + SH + """, ed AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), r AS (SELECT unit_id AS source, unit_id AS node, 0 AS hops FROM u UNION SELECT r.source, ed.dst, r.hops + 1 FROM r JOIN ed ON r.node = ed.src WHERE r.hops < 3),
m AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY 1, 2) SELECT m.source, m.node, m.hops, min(x.node) AS via FROM m JOIN ed ON ed.dst = m.node JOIN m x ON x.source = m.source AND x.node = ed.src AND x.hops = m.hops - 1 WHERE m.hops > 0 GROUP BY 1, 2, 3""")
def neighbourhood_depth(spark, sf):
    """Everything within three similarity links of every document, with the step before it."""
    members, pairs = dup_groups(spark, sf)
    return G.reach_of_groups(members, pairs, 3)


# -- passages and structure

PSQL = T1 + """, me AS (SELECT DISTINCT section_id, unit_num FROM w WHERE term = 'heti'), l AS (SELECT *, coalesce((unit_num - lag(unit_num) OVER (PARTITION BY section_id ORDER BY unit_num) > 3)::int, 1) AS nw FROM me),
pn AS (SELECT *, sum(nw) OVER (PARTITION BY section_id ORDER BY unit_num) AS passage FROM l), pa AS (SELECT section_id, passage, min(unit_num) AS start, max(unit_num) AS stop, count(*) AS mentions FROM pn GROUP BY 1, 2),
pu AS (SELECT pa.section_id, passage, u.unit_id FROM pa JOIN u ON pa.section_id = u.section_id AND u.unit_num BETWEEN greatest(1, start - 1) AND stop + 1),
ra AS (SELECT term FROM w GROUP BY term HAVING count(*) < 500), mc AS (SELECT pu.section_id, passage, term, count(*) AS total FROM pu JOIN w USING (unit_id) JOIN ra USING (term) GROUP BY 1, 2, 3),
mo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id, passage ORDER BY total DESC, term) AS rank FROM mc) WHERE rank <= 40)"""


def found_passages(spark, sf):
    units = V.units(spark, sf)
    occurrences = V.occurrences(units)
    p = N.merge_mentions(occurrences.where(F.col("term") == "heti").select("section_id", "unit_num"), gap=2)
    return p, N.motifs(N.widen(p, units, 1), occurrences)


@query("figure_passages", PSQL + " SELECT section_id, passage, start, stop, mentions FROM pa")
def figure_passages(spark, sf):
    return found_passages(spark, sf)[0].withColumnRenamed("end", "stop")


@query("passage_motifs", PSQL + " SELECT section_id, passage, term, total, rank FROM mo")
def passage_motifs(spark, sf):
    return found_passages(spark, sf)[1]


@query("passage_diff", PSQL + """, ch AS (SELECT *, row_number() OVER (ORDER BY stop - start DESC, section_id, start) AS nr FROM pa QUALIFY nr <= 12), m AS (SELECT mo.*, nr FROM mo JOIN ch USING (section_id, passage)), fr AS (SELECT term, count(*) AS f FROM m GROUP BY 1),
ba AS (SELECT term, rank AS base FROM m WHERE nr = 1), rk AS (SELECT section_id, passage, m.term, rank, base FROM m JOIN ba USING (term)),
iv AS (SELECT x.section_id, x.passage, count(*) AS pairs, sum((x.rank > y.rank)::int) AS inversions FROM rk x JOIN rk y ON x.section_id = y.section_id AND x.passage = y.passage AND x.base < y.base GROUP BY 1, 2)
SELECT m.section_id, m.passage, nr, count(*) AS motifs, sum((f = (SELECT count(*) FROM ch))::int) AS shared_by_all, sum((f = 1)::int) AS adds, (SELECT count(*) FROM fr) - count(*) AS omits, coalesce(max(inversions), 0) AS inversions, coalesce(max(pairs), 0) AS pairs
FROM m JOIN fr USING (term) LEFT JOIN iv ON m.section_id = iv.section_id AND m.passage = iv.passage GROUP BY m.section_id, m.passage, nr""")
def passage_diff(spark, sf):
    p, m = found_passages(spark, sf)
    return N.passage_differences(N.longest(p), m)


KSQL = T1 + """, cs AS (SELECT u.section_id, u.unit_num, u.unit_id, coalesce(list_distinct(list(t.term) FILTER (WHERE t.term IS NOT NULL)), []) AS terms FROM u LEFT JOIN (SELECT unit_id, term FROM w WHERE term IN (SELECT term FROM w GROUP BY term HAVING count(*) <= 400)) t USING (unit_id) GROUP BY 1, 2, 3),
nx AS (SELECT section_id, unit_num, terms, lead(terms) OVER (PARTITION BY section_id ORDER BY unit_num) AS nt FROM cs), co AS (SELECT section_id, unit_num, CASE WHEN len(terms) = 0 OR len(nt) = 0 THEN 0 ELSE len(list_intersect(terms, nt)) / len(list_distinct(list_concat(terms, nt))) END AS cohesion FROM nx WHERE nt IS NOT NULL)"""


def sets(spark, sf):
    units = V.units(spark, sf)
    return N.content_sets(V.occurrences(units).select("unit_id", "term"), units)


@query("cohesion", KSQL + " SELECT section_id, unit_num, round(cohesion, 6) AS cohesion FROM co")
def cohesion(spark, sf):
    return N.cohesion(sets(spark, sf)).withColumn("cohesion", F.round("cohesion", 6))


@query("boundaries", KSQL + """, z AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY section_id) + 1 AS n, coalesce(cohesion = 0 AND lag(cohesion) OVER o = 0 AND lead(cohesion) OVER o = 0, false) AS zero FROM co WINDOW o AS (PARTITION BY section_id ORDER BY unit_num)),
y AS (SELECT *, i = 0 OR (zero AND (row_number() OVER (PARTITION BY section_id, zero ORDER BY unit_num) - 1) % greatest(1, n // 12) = 0) AS br FROM z WHERE n >= 4), r AS (SELECT *, sum(br::int) OVER (PARTITION BY section_id ORDER BY unit_num) AS run FROM y)
SELECT section_id, min(unit_num) AS start, max(unit_num) + 1 AS stop, count(*) + 1 AS units, round(avg(cohesion), 6) AS mean_cohesion FROM r GROUP BY section_id, run""")
def boundaries(spark, sf):
    out = N.boundaries(N.cohesion(sets(spark, sf)))
    return out.select("section_id", "start", F.col("end").alias("stop"), "units", F.round("mean_cohesion", 6).alias("mean_cohesion"))


@query("ring_score", KSQL + """, s AS (SELECT section_id, terms, row_number() OVER (PARTITION BY section_id ORDER BY unit_num) - 1 AS i, count(*) OVER (PARTITION BY section_id) AS n FROM cs),
j AS (SELECT x.section_id, x.i, y.i AS j, x.n, CASE WHEN len(x.terms) = 0 OR len(y.terms) = 0 THEN 0 ELSE len(list_intersect(x.terms, y.terms)) / len(list_distinct(list_concat(x.terms, y.terms))) END AS v FROM s x JOIN s y ON x.section_id = y.section_id
 WHERE (y.i = x.n - 1 - x.i AND x.i < x.n // 2) OR (x.i % greatest(1, x.n // 10) = 0 AND y.i >= x.i + 2 AND (y.i - x.i - 2) % greatest(1, x.n // 10) = 0))
SELECT section_id, coalesce(round(avg(v) FILTER (WHERE j = n - 1 - i AND i < n // 2), 4), 0) AS mirror, coalesce(round(avg(v) FILTER (WHERE i % greatest(1, n // 10) = 0 AND j >= i + 2 AND (j - i - 2) % greatest(1, n // 10) = 0), 4), 0) AS background FROM j GROUP BY section_id""")
def ring_score(spark, sf):
    return N.ring_scores(sets(spark, sf)).drop("candidate")


# -- evidence over documents


@query("citation_check", f"WITH {V.U}, r AS (SELECT unit_id AS span, concat(section_id, ':', unit_num + 45) AS ref FROM u) SELECT span, ref, concat(split_part(ref, ':', 1), ':', split_part(ref, ':', 2)) IN (SELECT concat(section_id, ':', unit_num) FROM u) AS resolves FROM r")
def citation_check(spark, sf):
    units = V.units(spark, sf)
    spans = units.select(F.col("unit_id").alias("span"), F.lit("ayah").alias("kind"), F.concat_ws(":", "section_id", (F.col("unit_num") + 45).cast("string")).alias("ref"), F.lit("e").alias("edition"))
    docs = V.table(spark, sf, "benchmark").select(F.lit("e").alias("edition"), F.col("item_id").alias("number"))
    return E.check_citations(spans, units.select("section_id", "unit_num"), docs).select("span", "ref", "resolves")


@query("grading_audit", "SELECT d.source, count(*) AS total, sum((l.quality IS NULL)::int) AS ungraded, sum(coalesce(l.quality = 0, false)::int) AS weak FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def grading_audit(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source").join(V.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "weak").otherwise("sound").alias("grading")), "doc_id", "left")
    return E.grading_audit(d, key="source")


@query("fingerprints", f"SELECT doc_id, sha256(CASE WHEN len(list_filter({V.TOKENS}, lambda x: length(x) > 12)) > 0 THEN array_to_string(list_sort(list_distinct(list_filter({V.TOKENS}, lambda x: length(x) > 12))), '|') ELSE source END) AS fingerprint FROM documents")
def fingerprints(spark, sf):
    runs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.filter(X.words(F.col("text")), lambda x: F.length(x) > 12).alias("terms"), F.col("source").alias("question"))
    return E.fingerprints(runs).select(F.col("run_id").alias("doc_id"), "fingerprint")


@query("span_ids", "SELECT doc_id, substr(sha256(concat('ayah|', doc_id, '|', source, '|', substr(text, 1, 120))), 1, 12) AS span_id FROM documents")
def span_ids(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", E.span_id(F.lit("ayah"), F.col("doc_id"), F.col("source"), F.col("text")).alias("span_id"))


ASSESSED = sweep(1) + " SELECT term, n, k AS observed, round(n * rate, 6) AS expected, round(p, 6) AS p_value, round(2 * asin(sqrt(k / n)) - 2 * asin(sqrt(rate)), 6) AS effect"


def assessed(spark, sf):
    share = V.plain_units(spark, sf).agg((F.sum(F.when(F.col("cohort") == "A", F.col("n_words")).otherwise(0)) / F.sum("n_words")).alias("rate"))
    c = occ(spark, sf).groupBy("term").agg(F.count("*").alias("n"), F.sum((F.col("cohort") == "A").cast("int")).alias("observed"))
    s = c.join(F.broadcast(share)).withColumn("sig", assess(F.col("observed"), F.col("n"), F.col("rate")))
    return s.select("term", "n", "observed", F.round("sig.expected", 6).alias("expected"), F.round("sig.p_value", 6).alias("p_value"), F.round("sig.effect", 6).alias("effect"), "sig.warnings")


@query("binomial_assess", ASSESSED + " FROM tails")
def binomial_assess(spark, sf):
    """Every term, however rare or common, against a cohort's share of all words."""
    return assessed(spark, sf).drop("warnings")


@query("binomial_assess_all", ASSESSED + """, array_to_string(list_filter([CASE WHEN n < 20 THEN 'small_sample' END, CASE WHEN n * rate < 5 THEN 'few_expected' END,
CASE WHEN abs(2 * asin(sqrt(k / n)) - 2 * asin(sqrt(rate))) < 0.2 AND p < 0.05 THEN 'small_effect' END], lambda x: x IS NOT NULL), ',') AS warnings FROM tails""")
def binomial_assess_all(spark, sf):
    """The same with the warnings."""
    return assessed(spark, sf).withColumn("warnings", F.array_join("warnings", ","))


def source_tests(spark, sf):
    """Documents in English of every source against the share over all, as a family of tests."""
    d = V.table(spark, sf, "documents")
    share = d.agg(F.avg((F.col("lang") == "en").cast("double")).alias("rate"))
    c = d.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("lang") == "en").cast("int")).alias("k"))
    return c.join(F.broadcast(share)).withColumn("p_value", assess(F.col("k"), F.col("n"), F.col("rate"))["p_value"])


FAM = f"WITH sh AS (SELECT avg((lang = 'en')::int) AS rate FROM documents), c AS (SELECT source, count(*) AS n, sum((lang = 'en')::int) AS k FROM documents GROUP BY 1), p AS (SELECT source, {V.p_value('k', 'n', 'rate')} AS p FROM c, sh)"


@query("bh_correction", FAM + ", r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS rank, count(*) OVER () AS m FROM p) SELECT source, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS corrected_p FROM r")
def bh_correction(spark, sf):
    return correct_multiple(source_tests(spark, sf), order=("source",)).select("source", F.round("corrected_p", 6).alias("corrected_p"))


@query("bonferroni", FAM + " SELECT source, round(least(1.0, p * count(*) OVER ()), 6) AS corrected_p FROM p")
def bonferroni(spark, sf):
    return correct_multiple(source_tests(spark, sf), method="bonferroni").select("source", F.round("corrected_p", 6).alias("corrected_p"))


@query("number_guard", T1 + ", c AS (SELECT term, count(*) AS n FROM w GROUP BY 1) SELECT term, n FROM c WHERE n IN (7, 19, 40, 99, 114, 786)")
def number_guard(spark, sf):
    from verbatlas.functions.stats import loaded_numbers

    c = occ(spark, sf).groupBy("term").agg(F.count("*").alias("n"))
    return c.where(F.size(loaded_numbers(F.array("n"), F.lit(0))) > 0)

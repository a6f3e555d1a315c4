"""Registered queries over loaders, script folding and the smaller operators, with their DuckDB counterparts.

Loaders read what these queries land in the shared folder first, made from the supplied tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions import stats as ST
from verbatlas.functions import text as X
from verbatlas.operators import claims as H
from verbatlas.operators import conditionals as Q
from verbatlas.operators import derive as D
from verbatlas.operators import evidence as E
from verbatlas.operators import lexical as L
from verbatlas.operators import retrieval as R
from verbatlas.operators import vectors as VEC
from verbatlas.operators import workspace as W
from verbatlas.plans import table_queries as TQ
from verbatlas.plans import text_queries as TX
from verbatlas.plans import views as V
from verbatlas.plans.registry import query
from verbatlas.sources import load as S
from verbatlas.sources.shared import shared_folder, stash
from verbatlas.streaming import telemetry as M


def landing(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/verbatlas/{name}-{uuid.uuid4().hex}"


# -- script text: the supplied texts, transliterated; digits become marks and c a letter of own prose

FROM, TO = X.LATIN_FROM + "0123456789c", X.LATIN_TO + "ًٌٍَُِّْٰـچ"


def script(text: F.Column) -> F.Column:
    return F.translate(text, FROM, TO)


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"




def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{X.MARKS}', '', 'g')"


def fold_sql(x: str, hamza: bool = False) -> str:
    return f"translate({x}, '{X.FOLD_FROM}{X.HAMZA * hamza}', '{X.FOLD_TO}{X.ALEF * hamza}')"


def search_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold_sql(strip_sql(x))}, '{X.NOT_LETTERS}', ' ', 'g'), '\\s+', ' ', 'g'))"


def align_sql(x: str) -> str:
    return f"regexp_replace({fold_sql(search_sql(x), True)}, '{X.ALEF}{{2,}}', '{X.ALEF}', 'g')"


def script_sql(x: str) -> str:
    return f"translate({x}, {_sql(FROM)}, {_sql(TO)})"


def key_sql(value: str) -> str:
    """SQL for the term key of a Latin value."""
    latin = f"regexp_replace(translate(trim(coalesce({value}, '')), {_sql(X.LATIN_FROM)}, {_sql(X.LATIN_TO)}), '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')"
    joined = f"regexp_replace({latin}, '{X.SEPARATORS}', '', 'g')"
    return f"translate(regexp_replace({joined}, '{X.MARKS}', '', 'g'), '{X.FOLD_FROM}{X.HAMZA}', '{X.FOLD_TO}{X.ALEF}')"


@query("script_forms", f"""WITH s AS (SELECT doc_id, {script_sql('text')} AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5({strip_sql('x')}) AS stripped, md5({fold_sql('x')}) AS folded, md5({search_sql('x')}) AS search, md5({align_sql('x')}) AS aligned,
md5(replace({align_sql('x')}, '{X.ALEF}', '')) AS loose, len(list_filter(string_split({search_sql('x')}, ' '), lambda t: t <> '')) AS n_tokens FROM s""")
def script_forms(spark, sf):
    """T1 to T5 and T8 on whole texts in the script."""
    x = F.col("x")
    docs = V.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", script(F.col("text")).alias("x"))
    return docs.select("doc_id", F.md5(X.strip_marks(x)).alias("stripped"), F.md5(X.fold_letters(x)).alias("folded"), F.md5(X.search_form(x)).alias("search"), F.md5(X.align_form(x)).alias("aligned"), F.md5(X.loose_form(x)).alias("loose"), F.size(X.tokens(x)).alias("n_tokens"))


@query("script_letters", f"SELECT p_partkey, array_to_string(list_filter(string_split({key_sql('p_name')}, ''), lambda t: t <> ''), '-') AS letters FROM part")
def script_letters(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(X.term_letters(F.col("p_name")), "-").alias("letters"))


@query("script_quotes", f"""WITH l AS (SELECT item_id, unnest(string_split({script_sql('text')}, chr(10))) AS line, generate_subscripts(string_split({script_sql('text')}, chr(10)), 1) AS nr FROM benchmark),
w AS (SELECT item_id, nr, unnest(regexp_extract_all(line, '{X.SCRIPT_WORD}')) AS word, generate_subscripts(regexp_extract_all(line, '{X.SCRIPT_WORD}'), 1) AS pl FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(word, '{X.QUOTE_MARKS}') THEN 'mark' WHEN regexp_matches(word, '{X.PROSE_LETTERS}') THEN 'prose' WHEN length(word) < 2 THEN 'skip' ELSE 'plain' END AS kind FROM w),
g AS (SELECT *, sum((kind IN ('mark', 'prose'))::int) OVER (PARTITION BY item_id, nr ORDER BY pl) AS part FROM k),
e AS (SELECT item_id, nr, part, max(CASE WHEN kind IN ('mark', 'prose') THEN pl END) AS opens, string_agg(word, ' ' ORDER BY pl) FILTER (WHERE kind = 'plain') AS run, count(*) FILTER (WHERE kind = 'plain') AS n FROM g GROUP BY 1, 2, 3),
c AS (SELECT e.*, lead(k.kind) OVER (PARTITION BY e.item_id, e.nr ORDER BY e.part) AS closed_by FROM e LEFT JOIN k ON k.item_id = e.item_id AND k.nr = e.nr AND k.pl = e.opens),
r AS (SELECT item_id, run FROM c WHERE n >= 3 AND closed_by IS DISTINCT FROM 'mark' UNION ALL SELECT item_id, word FROM k WHERE kind = 'mark') SELECT item_id, run, count(*) AS n FROM r GROUP BY 1, 2""")
def script_quotes(spark, sf):
    """Quotations in script texts (T15)."""
    runs = V.table(spark, sf, "benchmark").select("item_id", F.explode(X.quoted_runs(script(F.col("text")))).alias("run"))
    return runs.groupBy("item_id", "run").agg(F.count("*").alias("n"))


# -- loaders


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return V.units(spark, sf).where("text IS NOT NULL")


ED = f"""WITH {V.U}, d AS (SELECT *, {script_sql('text')} AS x, concat('alt ', unit_id) AS alt FROM u WHERE text IS NOT NULL)"""


@query("edition_units", ED + f""" SELECT section_id * 100000 + unit_num AS unit_id, section_id, unit_num, md5(CASE WHEN unit_num % 3 = 0 THEN alt ELSE x END) AS alt_text, md5({search_sql('x')}) AS text_search, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')) AS n_words,
 len(regexp_extract_all({strip_sql('x')}, '\\p{{L}}')) AS n_letters, concat('S', section_id) AS section_name, CASE section_id % 2 WHEN 0 THEN 'old' ELSE 'new' END AS cohort, block_id, ordinal FROM d""")
def edition_units(spark, sf):
    """Two editions and a structure file, landed as JSON a block of units at a time, then loaded (S1)."""
    d = corpus(spark, sf).withColumn("x", script(F.col("text")))
    base = landing(spark, "edition")
    verse = lambda text: F.collect_list(F.struct(F.col("section_id").alias("chapter"), F.col("unit_num").alias("verse"), text.alias("text"))).alias("quran")
    d.groupBy("section_id", "block_id").agg(verse(F.col("x"))).select("quran").write.json(f"{base}/primary")
    d.where("unit_num % 3 = 0").groupBy("section_id", "block_id").agg(verse(F.concat(F.lit("alt "), F.col("unit_id").cast("string")))).select("quran").write.json(f"{base}/alternative")
    verses = F.collect_list(F.struct(F.col("unit_num").alias("verse"), F.lit(1).alias("juz"), F.col("block_id").alias("ruku"), F.lit(1).alias("page"), F.lit(1).alias("hizb"), F.lit(1).alias("manzil"), F.lit(False).alias("sajda")))
    chapter = F.struct(F.col("section_id").alias("chapter"), F.lit("").alias("name"), F.lit("").alias("arabicname"), F.concat(F.lit("S"), F.col("section_id").cast("string")).alias("englishname"), F.when(F.col("section_id") % 2 == 0, "Old").otherwise("New").alias("revelation"), F.col("verses"))
    d.groupBy("section_id", "block_id").agg(verses.alias("verses")).select(F.array(chapter).alias("chapters")).write.json(f"{base}/structure")
    ordinals = d.select("section_id", "ordinal").distinct()
    out = S.build_units(S.read_edition(spark, f"{base}/primary", False), S.read_edition(spark, f"{base}/alternative", False), S.read_structure(spark, f"{base}/structure", False), ordinals)
    return out.select("unit_id", "section_id", "unit_num", F.md5("alt_text").alias("alt_text"), F.md5("text_search").alias("text_search"), "n_words", "n_letters", "section_name", "cohort", "block_id", "ordinal")


HEAD = "(SELECT regexp_split_to_array(min(text), '\\s+')[1:2] FROM u WHERE unit_num = 1 AND len(regexp_split_to_array(text, '\\s+')) > 2)"


@query("heading_strip", f"WITH {V.U}, h AS (SELECT {HEAD} AS head), s AS (SELECT unit_id, section_id, unit_num, text, regexp_split_to_array(text, '\\s+') AS t FROM u WHERE text IS NOT NULL)" + f""" SELECT unit_id, md5(CASE WHEN unit_num = 1 AND section_id <> 3 AND len(t) > 2 AND list_transform(t[1:2], lambda w: {search_sql(script_sql('w'))}) = list_transform(head, lambda w: {search_sql(script_sql('w'))})
 THEN array_to_string(list_transform(t[3:], lambda w: {script_sql('w')}), ' ') ELSE {script_sql('text')} END) AS text FROM s, h""")
def heading_strip(spark, sf):
    """First units without a heading, which is taken from the data; section 3 keeps it (S2)."""
    d = corpus(spark, sf)
    first = d.where((F.col("unit_num") == 1) & (F.size(F.split("text", r"\s+")) > 2)).agg(F.min("text")).first()[0]
    heading = spark.range(1).select(F.transform(F.slice(F.split(F.lit(first), r"\s+"), 1, 2), script)).first()[0] if first else ["none"]
    out = S.strip_heading(d.withColumn("text", script(F.col("text"))), heading, not_in=[3])
    return out.select("unit_id", F.md5("text").alias("text"))


@query("ordinal_check", f"WITH {V.U}, o AS (SELECT DISTINCT section_id, ordinal FROM u) SELECT count(*) AS rows, min(ordinal) AS lowest, max(ordinal) AS highest, count(DISTINCT ordinal) AS \"distinct\", count(DISTINCT section_id) AS sections, count(*) = count(DISTINCT section_id) AND min(ordinal) = 1 AND max(ordinal) = count(DISTINCT section_id) AND count(DISTINCT ordinal) = count(DISTINCT section_id) AS valid FROM o")
def ordinal_check(spark, sf):
    sections = V.plain_units(spark, sf).select("section_id", "ordinal").distinct()
    return S.ordinal_report(sections.select("ordinal"), sections)


@query("annotation_lines", "SELECT l_orderkey AS section_id, l_linenumber AS unit_num, 1 AS position, l_quantity::int AS seg, l_returnflag AS form, l_linestatus AS coarse, CASE WHEN l_orderkey % 10 = 3 THEN '' ELSE concat('ROOT:', l_partkey) END AS features FROM lineitem WHERE l_orderkey % 10 > 2")
def annotation_lines(spark, sf):
    """Annotation lines with comments, short lines and bad places among them, landed as text and parsed (S5)."""
    path = landing(spark, "annotation")
    o = F.col("l_orderkey")
    place = F.concat_ws(":", o.cast("string"), F.col("l_linenumber").cast("string"), F.lit("1"), F.col("l_quantity").cast("int").cast("string"))
    body = F.concat_ws("\t", F.lit(""), "l_returnflag", "l_linestatus")
    line = F.when(o % 10 == 0, F.concat(F.lit("# "), place)).when(o % 10 == 1, F.concat_ws("\t", place, "l_returnflag")).when(o % 10 == 2, F.concat(F.lit("1:x:2"), body)).when(o % 10 == 3, F.concat(place, body)).otherwise(F.concat(place, body, F.lit("\tROOT:"), F.col("l_partkey").cast("string")))
    V.table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    return S.parse_annotation(spark.read.text(path))


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return TX.full_occ(spark, sf).select("term", F.substring("term", 1, 3).alias("lemma"), (F.col("unit_id") * 100_000 + F.col("position")).alias("line_no"))


@query("term_dictionary", TX.T1 + f", k AS (SELECT term, {key_sql('term')} AS key, unit_id * 100000 + position AS line_no FROM w) SELECT key, min_by(term, line_no) AS display, count(*) AS occurrences FROM k GROUP BY key")
def term_dictionary(spark, sf):
    return S.dictionaries(annotated(spark, sf))[0]


@query("lemma_dictionary", TX.T1 + f", k AS (SELECT substr(term, 1, 3) AS lemma, {key_sql('term')} AS term, unit_id * 100000 + position AS line_no FROM w) SELECT lemma, term, min(line_no) AS first_line FROM k GROUP BY 1, 2")
def lemma_dictionary(spark, sf):
    return S.dictionaries(annotated(spark, sf))[1]


@query("stem_lift", "WITH s AS (SELECT l_orderkey AS unit_id, l_linenumber % 3 AS position, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS seg, CASE WHEN l_returnflag <> 'N' THEN cast(l_partkey AS varchar) END AS term, cast(l_suppkey AS varchar) AS lemma, l_linestatus AS coarse, l_linestatus = 'O' AS affix FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, position ORDER BY CASE WHEN term IS NOT NULL THEN 0 WHEN NOT affix THEN 1 ELSE 2 END, seg) AS n FROM s) SELECT unit_id, position, term, lemma, coarse FROM r WHERE n = 1")
def stem_lift(spark, sf):
    line = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") % 3).alias("position"), ((F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("seg"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey").cast("string")).alias("term"), F.col("l_suppkey").cast("string").alias("lemma"), F.col("l_linestatus").alias("coarse"), (F.col("l_linestatus") == "O").alias("is_prefix"), F.lit(False).alias("is_suffix"))
    return S.lift_stems(line)


@query("edition_texts", f"WITH {V.U} SELECT unit_id, 'bench' AS edition, trim(b.text) AS text FROM benchmark b JOIN u ON section_id = item_id % 20 AND unit_num = item_id % 60 + 1 WHERE trim(b.text) <> '' AND item_id % 5 > 0")
def edition_texts(spark, sf):
    """Unit-keyed texts: trimmed, without empty ones and unknown units (S10)."""
    i = F.col("item_id")
    rows = V.table(spark, sf, "benchmark").select((i % 20).cast("int").alias("section_id"), (i % 60 + 1).cast("int").alias("unit_num"), F.when(i % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.lit("  "))).alias("text"))
    return S.load_texts(rows, V.units(spark, sf), "bench")


@query("lexicon_load", f"WITH t AS (SELECT {key_sql('p_brand')} AS key, min(p_brand) AS display FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey AS ref, p_type AS headword, display AS term FROM part LEFT JOIN t ON key = {key_sql('CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END')} WHERE p_partkey % 7 > 0")
def lexicon_load(spark, sf):
    """Lexicon lines landed as JSON and joined to a dictionary; unmatched ones stay (S13)."""
    part, path = V.table(spark, sf, "part"), landing(spark, "lexicon")
    k = F.col("p_partkey")
    part.select(F.when(k % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("root"), F.col("p_type").alias("headword"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("text"), k.cast("string").alias("ref")).write.json(path)
    terms = part.where(k % 2 == 0).groupBy(X.term_key(F.col("p_brand")).alias("key")).agg(F.min("p_brand").alias("display"))
    return S.load_lexicon(spark, path, terms).select(F.col("ref").cast("long").alias("ref"), "headword", "term")


@query("provenance_log")
def provenance_log(spark, sf):
    """Digest and size of the files behind each table (S15); a file's bytes are beyond SQL over tables."""
    out = None
    for name in ("documents", "orders", "lineitem"):
        found = S.provenance(spark, name, [f"{sf}/{name}.parquet"], V.table(spark, sf, name)).select("step", "sha256", "bytes", "rows")
        out = found if out is None else out.unionByName(found)
    return out


@query("edition_partitions", "SELECT o_orderpriority AS kind, count(*) AS n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS replaced FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0 GROUP BY 1")
def edition_partitions(spark, sf):
    """A derived table of which one kind is built again and replaced alone (S16)."""
    path = landing(spark, "derived")
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.lit(0).alias("replaced"))
    S.write_partition(rows, path, "kind")
    S.write_partition(rows.where("kind = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("replaced", F.lit(1)), path, "kind")
    return spark.read.schema("o_orderkey long, replaced int, kind string").parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("replaced").alias("replaced"))


@query("golden_load", "SELECT o_orderpriority AS tier, o_orderstatus AS kind, count(*) AS n, min(concat('q ', o_orderkey)) AS question FROM orders GROUP BY 1, 2")
def golden_load(spark, sf):
    path = landing(spark, "golden")
    V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("q "), F.col("o_orderkey").cast("string")).alias("question"), F.lit("{}").alias("expect")).write.json(path)
    return S.load_golden(spark, path).groupBy("tier", "kind").agg(F.count("*").alias("n"), F.min("question").alias("question"))


# -- retrieval


@query("section_list", f"WITH {V.U} SELECT section_id, min(ordinal) AS ordinal, count(*) AS units, sum(n_words) AS words FROM u GROUP BY section_id")
def section_list(spark, sf):
    return R.section_list(V.plain_units(spark, sf))


@query("hit_spans", TX.T1 + " SELECT w.unit_id, position, concat(w.section_id, ':', w.unit_num) AS ref, term AS word_text, md5(text) AS unit_text FROM w JOIN u USING (unit_id) WHERE term = 'heat'")
def hit_spans(spark, sf):
    o = TX.occ(spark, sf)
    hits = o.where("term = 'heat'").select("unit_id", "position")
    return R.hydrate(hits, o.select("unit_id", "position", F.col("term").alias("text")), V.units(spark, sf)).select("unit_id", "position", "ref", "word_text", F.md5("unit_text").alias("unit_text"))


@query("unit_documents", "WITH l AS (SELECT doc_id, doc_id % 50 AS unit_id, n_chars % 7 / 7.0 AS confidence, coalesce(CASE quality WHEN 1 THEN 'strong' WHEN 0 THEN 'weak' END, 'unknown') AS grading FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY confidence DESC, doc_id) AS rank FROM l) SELECT unit_id, doc_id, grading, rank FROM r WHERE rank <= 20")
def unit_documents(spark, sf):
    docs = V.table(spark, sf, "documents")
    graded = docs.select("doc_id").join(V.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "strong").when(F.col("quality") == 0, "weak").otherwise("unknown").alias("grading"))
    links = docs.select("doc_id", (F.col("doc_id") % 50).alias("unit_id"), (F.col("n_chars") % 7 / 7.0).alias("confidence"))
    return R.quoting_documents(links, graded).select("unit_id", "doc_id", "grading", "rank")


@query("word_lookup", TX.T1 + " SELECT unit_id, position, term, substr(term, 1, 3) AS lemma FROM w WHERE section_id = 4 AND unit_num = 5 AND position = 3")
def word_lookup(spark, sf):
    o = TX.occ(spark, sf)
    return R.word_at(o.select("unit_id", "position"), o.select("unit_id", "position", "term", F.substring("term", 1, 3).alias("lemma")), 4, 5, 3, V.units(spark, sf))


@query("bm25_filtered", f"WITH {V.U.replace('FROM documents', 'FROM documents WHERE lang = $$de$$')}, {V.W} " + TX.BM + f" SELECT doc_id, round(sum({TX.BS}), 6) AS score FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('heat', 'und', 'der') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def bm25_filtered(spark, sf):
    """Filters come first: the corpus statistics are the filtered documents' own (L4)."""
    docs = V.table(spark, sf, "documents").where("lang = 'de'")
    return L.bm25_topk(["heat", "und", "der"], *L.build_index(docs, X.words(F.col("text"))), k=20).select("doc_id", F.round("score", 6).alias("score"))


KINDS = f"""WITH k AS (SELECT concat('doc:', doc_id) AS doc_id, {V.TOKENS} AS t FROM documents UNION ALL SELECT concat('item:', item_id), {V.TOKENS} FROM benchmark), o AS (SELECT doc_id, unnest(t) AS term FROM k), pp AS (SELECT doc_id, term, count(*) AS tf FROM o WHERE length(term) <= 64 GROUP BY 1, 2),
dl AS (SELECT doc_id, len(t) AS length FROM k), st AS (SELECT count(*) AS n, avg(length) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM pp GROUP BY term), s AS (SELECT doc_id, round(sum({TX.BS}), 6) AS score FROM pp JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('heat', 'und', 'anthe') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30)"""


@query("ranked_hits", KINDS + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) SELECT rank, kind, id, ref, score FROM (SELECT rank, 'doc' AS kind, substr(r.doc_id, 5) AS id, source AS ref, score FROM r JOIN documents d ON r.doc_id = concat('doc:', d.doc_id)
UNION ALL SELECT rank, 'item', substr(r.doc_id, 6), concat('item ', item_id), score FROM r JOIN benchmark b ON r.doc_id = concat('item:', item_id))""")
def ranked_hits(spark, sf):
    """One ranking over two kinds of documents, each hit with the reference of its kind (L5)."""
    docs, items = V.table(spark, sf, "documents").withColumn("id", F.col("doc_id")), V.table(spark, sf, "benchmark").withColumn("id", F.col("item_id"))
    index = L.index_of_kinds({"doc": (docs, X.words(F.col("text"))), "item": (items, X.words(F.col("text")))}, "id")
    hits = L.bm25_topk(["heat", "und", "anthe"], *index, k=30).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(30)
    return L.hydrate_kinds(hits, {"doc": docs.select("id", F.col("source").alias("ref")), "item": items.select("id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("ref"))}).select("rank", "kind", "id", "ref", "score")


@query("vector_filtered", f"WITH f AS (SELECT * FROM embeddings WHERE label = 3 AND vec_id % 3 = 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {TQ.QV}::DOUBLE[]), 5) AS score FROM f ORDER BY score DESC, vec_id LIMIT 7")
def vector_filtered(spark, sf):
    """The filter comes before the limit, so that no better match is lost to a pool (V2)."""
    v = V.table(spark, sf, "embeddings")
    q = list(v.orderBy("vec_id").select("embedding").first()[0])
    return VEC.topk(v.where("label = 3 AND vec_id % 3 = 1"), q, 7).select("vec_id", F.round("score", 5).alias("score"))


@query("vector_store", "SELECT 'a' AS model, len(embedding) AS dim, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY ALL UNION ALL SELECT 'b', len(embedding), count(*) FROM embeddings GROUP BY ALL")
def vector_store(spark, sf):
    """Vectors stored for each model; a model that is stored again replaces its own only (V3)."""
    v, path = V.table(spark, sf, "embeddings"), landing(spark, "vectors")
    dim = v.select(F.size("embedding")).first()[0]
    for model, rows in (("a", v), ("b", v), ("a", v.where("vec_id % 2 = 0"))):
        VEC.store(rows, path, model, dim)
    return spark.read.parquet(path).groupBy("model", "dim").agg(F.count("*").alias("n"))


@query("similar_to_unit", f"WITH {V.U}" + TX.SH + ", f AS (SELECT a, b, score FROM e UNION ALL SELECT b, a, score FROM e) SELECT a, b, round(score, 6) AS score FROM f WHERE a = (SELECT min(a) FROM f) AND score >= 0.7 ORDER BY score DESC, b LIMIT 20")
def similar_to_unit(spark, sf):
    members, pairs = TX.dup_groups(spark, sf)
    pairs = stash(pairs.select("a", "b", "score"), "similar")
    first = D.linked_unit(members, pairs)
    first = -1 if first is None else first
    return D.similar_to(D.group_edges(members, pairs, first), first, 0.7).select("a", "b", F.round("score", 6).alias("score"))


# -- claims, conditionals, evidence


@query("side_terms", TX.CSQL + ", sd AS (SELECT 'condition' AS side, unnest(ct) AS term FROM c UNION ALL SELECT 'consequence', unnest(rt) FROM c), n AS (SELECT side, term, count(*) AS total FROM sd GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY total DESC, term) AS rank FROM n) SELECT side, term, total, rank FROM r WHERE rank <= 20")
def side_terms(spark, sf):
    return Q.side_terms(TX.structures(spark, sf))


@query("conditional_structure", TX.CSQL + " SELECT c.unit_id, word_start, word_end, confidence, n_words FROM c JOIN u ON u.unit_id = c.unit_id WHERE c.unit_id = (SELECT min(unit_id) FROM c)")
def conditional_structure(spark, sf):
    found = TX.structures(spark, sf).drop("cohort")
    first = found.agg(F.min("unit_id")).first()[0]
    return Q.with_unit(found, V.plain_units(spark, sf), first if first is not None else -1).select("unit_id", "word_start", "word_end", "confidence", "n_words")


CONDITIONAL = [(1, ["heat"]), (2, ["heti", "und"]), (3, ["the"]), (4, ["no such term"])]


@query("conditional_claims", TX.CSQL + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s!r}::VARCHAR[])" for i, s in CONDITIONAL) + ") v(claim_id, subject)) SELECT claim_id, sum(list_has_any(ct, subject)::int) AS as_condition, sum(list_has_any(rt, subject)::int) AS as_consequence, count(*) AS either FROM q, c WHERE list_has_any(ct, subject) OR list_has_any(rt, subject) GROUP BY claim_id")
def conditional_claims(spark, sf):
    claims = spark.createDataFrame([(i, "conditional", s) for i, s in CONDITIONAL], "claim_id long, claim_type string, subject array<string>")
    return H.conditional_claims(claims, TX.structures(spark, sf))


@query("claim_sample", TQ.claim_cte() + ", l AS (SELECT claim_id, key, CASE WHEN (claim_type = 'never_with') = (o = 1) AND claim_type <> 'distribution' THEN 'violating' WHEN claim_type = 'distribution' AND f.inside = 0 THEN 'violating' ELSE 'supporting' END AS role FROM f JOIN cl USING (claim_id) WHERE s = 1), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, role ORDER BY key) AS rank FROM l) SELECT claim_id, key, role, rank FROM r WHERE rank <= 10")
def claim_sample(spark, sf):
    return H.describe(TQ.tested(spark, sf)[1], 10).select("claim_id", "key", "role", "rank")


@query("stored_claims", TQ.claim_cte() + " SELECT claim_id, verdict AS status, violating AS violating_ids, supporting AS supporting_ids FROM v WHERE subject_units > 0")
def stored_claims(spark, sf):
    """Verdict rows with their whole id lists, here counted (W4)."""
    out = W.stored_runs(*TQ.tested(spark, sf)).where("subject_units > 0")
    return out.select("claim_id", "status", F.size("violating_ids").alias("violating_ids"), F.size("supporting_ids").alias("supporting_ids"))


@query("question_terms", rf"""WITH l AS (SELECT DISTINCT n_name AS term, lower(n_name) AS surface FROM nation), c AS (SELECT o_orderkey AS claim_id, lower(concat('do ', string_agg(n_name, ' and ' ORDER BY l_linenumber, n_name), ' trade')) AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY o_orderkey),
h AS (SELECT claim_id, term, instr(concat(' ', text, ' '), concat(' ', surface, ' ')) AS "at" FROM c JOIN l ON instr(concat(' ', text, ' '), concat(' ', surface, ' ')) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY "at", term) AS "order" FROM h) SELECT claim_id, term, "at", "order" FROM r WHERE "order" <= 4""")
def question_terms(spark, sf):
    """Terms that a question names, the first four (E15)."""
    nation = V.table(spark, sf, "nation")
    line = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    named = line.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n_name"))).alias("x"))
    asked = named.select("claim_id", F.concat(F.lit("do "), F.array_join(F.transform("x", lambda x: x["n_name"]), " and "), F.lit(" trade")).alias("text"))
    return H.resolve_terms(asked, nation.select(F.lower("n_name").alias("surface"), F.col("n_name").alias("term")), most=4).select("claim_id", "term", "at", "order")


@query("baseline_gaps", "SELECT doc_id, quality AS observed FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def baseline_gaps(spark, sf):
    known = V.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.col("n_chars").cast("double").alias("baseline"))
    return E.lacking_baseline(V.table(spark, sf, "labels").join(known, "doc_id", "left").select("doc_id", F.col("quality").alias("observed"), "baseline")).select("doc_id", "observed")


@query("report_verdict", "SELECT sum((o_orderstatus = 'F')::int) AS refuted, sum((o_orderstatus = 'P')::int) AS unsupported, (SELECT sum((l_returnflag = 'R')::int) FROM lineitem) AS failed, (SELECT count(*) FROM lineitem) AS checked, (SELECT sum((quality IS NULL)::int) FROM labels) AS no_baseline, 'blocked' AS verdict FROM orders")
def report_verdict(spark, sf):
    claims = V.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "refuted").when(F.col("o_orderstatus") == "P", "needs_evidence").otherwise("open").alias("status"))
    return E.report_verdict(claims, V.table(spark, sf, "lineitem").select((F.col("l_returnflag") != "R").alias("resolves")), V.table(spark, sf, "labels").select(F.col("quality").alias("baseline")))


def conversation_refs(spark, sf):
    return V.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.concat_ws(":", (F.length("text") % 4 + 1).cast("string"), (F.col("turn") % 3 + 1).cast("string")).alias("ref"))


REFS = "WITH s AS (SELECT conv_id AS run_id, turn AS seq, length(text) % 4 + 1 AS section_id, concat(length(text) % 4 + 1, ':', turn % 3 + 1) AS ref FROM conversations)"


@query("run_top_refs", REFS + ", f AS (SELECT run_id, ref, min(seq) AS seq FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, ref) AS rank FROM f) SELECT run_id, ref, rank FROM r WHERE rank <= 3")
def run_top_refs(spark, sf):
    return E.top_refs(conversation_refs(spark, sf)).select("run_id", "ref", "rank")


@query("run_sections", REFS + ", n AS (SELECT run_id, section_id, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, section_id) AS k FROM n) SELECT run_id, section_id FROM r WHERE k = 1")
def run_sections(spark, sf):
    return E.dominant_section(conversation_refs(spark, sf))


@query("prior_runs", f"WITH f AS (SELECT conv_id * 1000 + turn AS run_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS fingerprint FROM conversations) SELECT fingerprint, string_agg(cast(run_id AS varchar), ',' ORDER BY run_id) AS run_ids, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1")
def prior_runs(spark, sf):
    runs = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"), F.lit(None).cast("array<string>").alias("terms"), F.col("text").alias("question"))
    return E.prior_runs(runs).select("fingerprint", F.array_join(F.transform("run_ids", lambda x: x.cast("string")), ",").alias("run_ids"), "n")


# -- statistics


@query("chi2_poisson", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 5.0 AS x, (l_quantity::int % 12)::BIGINT AS k, l_quantity / 4.0 AS lam FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT l_orderkey, l_linenumber, round(1 - 2 / sqrt(pi()) * (SELECT sum(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln(sqrt(x / 2)) - lgamma(i + 1.0)) / (2 * i + 1)) FROM generate_series(0, 80) AS g(i)), 6) AS chi2,
round(CASE WHEN k <= 0 THEN 1.0 ELSE 1 - (SELECT sum(exp(-lam + i * ln(lam) - lgamma(i + 1.0))) FROM generate_series(0, k - 1) AS g(i)) END, 6) AS poisson FROM x""")
def chi2_poisson(spark, sf):
    q = F.col("l_quantity")
    line = V.table(spark, sf, "lineitem").where("l_quantity IS NOT NULL").select("l_orderkey", "l_linenumber", (q / 5.0).cast("double").alias("x"), (q.cast("int") % 12).cast("long").alias("k"), (q / 4.0).cast("double").alias("lam"))
    return line.select("l_orderkey", "l_linenumber", F.round(ST.chi2_sf_1df(F.col("x")), 6).alias("chi2"), F.round(ST.poisson_tail_upper(F.col("k"), F.col("lam")), 6).alias("poisson"))


@query("sweep_warnings", "SELECT source, count(*) * 0.05 AS expected_false_positives, count(*) > 1 AS warned FROM documents GROUP BY source")
def sweep_warnings(spark, sf):
    n = V.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", ST.sweep_warning(F.col("n")).alias("w")).select("source", F.col("w.expected_false_positives").alias("expected_false_positives"), F.col("w.warned").alias("warned"))


@query("event_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, nr")
def event_sessions(spark, sf):
    """Sessions of events with gaps under six hours, in batch (X3)."""
    out = M.session_rollup(TQ.user_events(spark, sf), "user_id", "ts")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "events")

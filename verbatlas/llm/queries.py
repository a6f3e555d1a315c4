"""Queries of this subpackage, each over a whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.cotraining import quality_scores
from verbatlas.llm.decontamination import MASKS, contaminated
from verbatlas.llm.extraction import main_texts
from verbatlas.llm.jaccard import jaccard_groups
from verbatlas.llm.language import identify_held_out
from verbatlas.llm.licenses import license_digest, scan_licenses
from verbatlas.llm.media import media_features, sniff_media, store_texts
from verbatlas.llm.mixing import mix_to_targets
from verbatlas.llm.runs import periodic_runs, run_digest, with_planted_runs
from verbatlas.llm.search import search_items
from verbatlas.llm.sharding import shard_documents
from verbatlas.llm.suffix_tree import score_held_out
from verbatlas.llm.tokens import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it overlaps; null and empty texts have none."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in one of 8 shards (law ``bytes``); null texts have size 1, equal rows get slots of their own."""
    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row; null texts have none, a null source is the last source."""
    return mix_to_targets(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every row; null texts score by metadata, null ids have no label."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as stored samples, read back; a null text is an empty one, equal texts have equal values."""
    found = media_features(sniff_media(store_texts(table(spark, sf_dir, "documents"))))
    inside = F.concat(F.lit(";embedded="), F.array_join(F.transform("embedded", lambda e: F.concat_ws("@", e["type"], e["offset"].cast("string"))), ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat("feature", inside).alias("feature"), "detected_type", "type_corrected")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes, links and groups of every row; rows without words or id stand alone, repeated ids share their group."""
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of every row under the vocabulary at ``tokenizer``; null texts have none."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row; null texts and texts without letters are ``und`` with score 0, a null id is held out."""
    return identify_held_out(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every row; a null text is an empty one, a null id is held out."""
    return score_held_out(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every row; null texts have none, and nulls for places that are not there."""
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; null texts hold no terms, a null id comes last among equal scores."""
    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50).select("item_id", "rank", "doc_id", "score")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every row, a tenth of which repeat a phrase of their own; null texts have no words, rows with a null id stay as they are."""
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty page has none, null ids and urls stay."""
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "agreed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_media": op5_media,
    "op6_jaccard": op6_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_scores": op9_scores,
    "op10_licenses": op10_licenses,
    "op11_search": op11_search,
    "op12_runs": op12_runs,
    "op13_pages": op13_pages,
}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_RUNS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _masked(t: str) -> str:
    """Both masks' words at position ``pos`` of list ``t``, each as one string."""
    masks = [" || ' ' || ".join(f"{t}[pos + {o}]" for o in mask) for mask in MASKS]
    return "[" + ", ".join(f"CASE WHEN pos + {mask[-1]} <= len({t}) THEN '{i} ' || {text} END" for i, (mask, text) in enumerate(zip(MASKS, masks, strict=True))) + "]"


ORACLE: dict[str, str] = {
    "op1_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), i AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
dp AS (SELECT doc_id, t, unnest(generate_series(1, len(t) - 4)) AS pos FROM d), ip AS (SELECT item_id, t, unnest(generate_series(1, len(t) - 4)) AS pos FROM i),
ds AS (SELECT doc_id, t, pos, unnest({_masked('t')}) AS seed FROM dp), s AS (SELECT item_id, t AS u, pos AS iat, unnest({_masked('t')}) AS seed FROM ip),
h AS (SELECT doc_id, item_id, pos, len(u) AS n, list_transform(generate_series(-11, 19), lambda k: CASE WHEN pos + k >= 1 AND iat + k >= 1 AND pos + k <= len(t) AND iat + k <= len(u) AND t[pos + k] = u[iat + k] THEN 1 ELSE 0 END) AS f FROM ds JOIN s USING (seed) WHERE seed IS NOT NULL),
m AS (SELECT doc_id, item_id, pos, least(12, n) AS w, list_max(list_transform(generate_series(1, 20), lambda k: list_sum(f[k:k + 11]))) AS m FROM h)
SELECT doc_id, item_id, min(pos) - 1 AS first_word, count(*) AS hits, max(m) AS matched, max(w) AS "window" FROM m WHERE m >= ceil(w * 10 / 12) GROUP BY 1, 2""",
    "op3_mixing": f"""WITH r0 AS (SELECT doc_id, source, len({_RUNS.format("coalesce(text, '')")}) AS size, md5(coalesce(text, '')) AS tx FROM documents),
r AS (SELECT doc_id, source, size, length(bin(size)) AS w, (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || tx || '|' || row_number() OVER (PARTITION BY doc_id, source, tx)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM r0),
s AS (SELECT source, sum(size)::BIGINT AS ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r GROUP BY 1),
o AS (SELECT *, 3 * ss AS cap, row_number() OVER k AS rank, coalesce(sum(3 * ss) OVER b, 0) AS cb, coalesce(sum(w) OVER b, 0) AS wb, sum(ss) OVER () AS t, sum(w) OVER () AS wt FROM s WINDOW k AS (ORDER BY 3 * ss / w, source NULLS LAST), b AS (ORDER BY 3 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (t - cb)::DOUBLE / (wt - wb) AS level FROM o), fr AS (SELECT min(rank) AS first, min_by(level, rank) AS level FROM l WHERE cap > level * w),
tg AS (SELECT source, ss, CASE WHEN first IS NULL OR rank < first THEN cap::DOUBLE ELSE fr.level * w END AS target FROM l, fr),
c0 AS (SELECT source, w, sum(size)::BIGINT AS words FROM r GROUP BY 1, 2),
c1 AS (SELECT c0.*, target, (coalesce(sum(words) OVER b, 0) * 3)::DOUBLE AS capped, (sum(w * words) OVER (PARTITION BY c0.source) - coalesce(sum(w * words) OVER b, 0))::DOUBLE AS rest FROM c0 JOIN tg ON c0.source IS NOT DISTINCT FROM tg.source WINDOW b AS (PARTITION BY c0.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, CASE WHEN rest <> 0 THEN (target - capped) / rest END AS level FROM c1),
c3 AS (SELECT *, max(CASE WHEN level * w <= 3 THEN w END) OVER (PARTITION BY source) AS fw, max_by(level, w) FILTER (WHERE level * w <= 3) OVER (PARTITION BY source) AS fl FROM c2),
c4 AS (SELECT source, w, words, target, CASE WHEN fw IS NULL OR w > fw THEN 3.0::DOUBLE ELSE fl * w END AS copies FROM c3),
c5 AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS part FROM c4),
c6 AS (SELECT source, greatest(0, max(target) - sum(whole * words)) AS budget, sum(CASE WHEN part > 0 THEN words ELSE 0 END)::DOUBLE AS op FROM c5 GROUP BY 1),
c7 AS (SELECT source, budget, least(greatest(coalesce(CASE WHEN op <> 0 THEN budget / op END, 0.5), 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS share FROM c6),
f AS (SELECT r.doc_id, r.source, r.size, r.u, tg.ss, tg.target, whole, part, budget, share / (1 - share) AS odds1 FROM r JOIN c5 ON r.source IS NOT DISTINCT FROM c5.source AND r.w = c5.w JOIN c7 ON r.source IS NOT DISTINCT FROM c7.source JOIN tg ON r.source IS NOT DISTINCT FROM tg.source),
q AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) * odds1 END AS odds FROM f), k AS (SELECT *, floor(odds / (1 + odds) * 281474976710656.0) AS rank FROM q),
c AS (SELECT *, sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank) AS upto FROM k), a AS (SELECT *, coalesce(rank IS NOT NULL AND upto <= budget, false) AS taken0 FROM c),
g1 AS (SELECT source, max(budget) - sum(CASE WHEN taken0 THEN size ELSE 0 END) AS gap FROM a WHERE rank IS NOT NULL GROUP BY 1),
x1 AS (SELECT a.source, min_by(rank, (abs(size - gap), rank)) AS r1 FROM a JOIN g1 ON a.source IS NOT DISTINCT FROM g1.source WHERE rank IS NOT NULL AND NOT taken0 AND size < 2 * gap GROUP BY 1),
b1 AS (SELECT a.*, taken0 OR coalesce(rank = r1, false) AS taken1 FROM a LEFT JOIN x1 ON a.source IS NOT DISTINCT FROM x1.source),
g2 AS (SELECT source, max(budget) - sum(CASE WHEN taken1 THEN size ELSE 0 END) AS gap FROM b1 WHERE rank IS NOT NULL GROUP BY 1),
x2 AS (SELECT b1.source, min_by(rank, (abs(size - gap), rank)) AS r2 FROM b1 JOIN g2 ON b1.source IS NOT DISTINCT FROM g2.source WHERE rank IS NOT NULL AND NOT taken1 AND size < 2 * gap GROUP BY 1)
SELECT doc_id, size, b1.source, ss AS source_size, target, (size * (whole + (taken1 OR coalesce(rank = r2, false))::int))::BIGINT AS taken, (CASE WHEN size > 0 THEN whole + (taken1 OR coalesce(rank = r2, false))::int ELSE 0 END)::BIGINT AS copies FROM b1 LEFT JOIN x2 ON b1.source IS NOT DISTINCT FROM x2.source""",
    "op6_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_RUNS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2), lambda k: array_to_string(w[k:k + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
g AS (SELECT doc_id, unnest(s) AS i, len(s) AS n FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, max(x.n) AS na, max(y.n) AS nb FROM g x JOIN g y ON x.i = y.i AND x.doc_id <> y.doc_id AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)), r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links, least(doc_id, coalesce((SELECT min(y) FROM r WHERE x = doc_id), doc_id)) AS component_id FROM s""",
    "op11_search": rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}') AS t FROM documents),
g AS (SELECT count(*)::BIGINT AS n_all, sum(len(t))::BIGINT AS l_all FROM d WHERE len(t) > 0), p AS (SELECT r, len(t)::BIGINT AS n, unnest(t) AS term FROM d), tf AS (SELECT r, term, any_value(n) AS n, count(*)::BIGINT AS tf FROM p GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY 1),
i AS (SELECT item_id, row_number() OVER () AS q, unnest(list_distinct(regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}'))) AS term FROM benchmark),
s AS (SELECT q, any_value(item_id) AS item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term), g GROUP BY q, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50""",
    "op12_runs": r"""WITH tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab FROM range(256) AS g(i)),
h AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
d0 AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
d1 AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, g FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1),
d AS (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM d2),
x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM d WHERE n >= 24),
e AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
f AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
m AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
l AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS runs,
  max(length::DOUBLE / period) AS top FROM m GROUP BY 1),
b AS (SELECT *, list_filter(runs, lambda x: x.l::DOUBLE / x.p = top)[1] AS best FROM l),
k AS (SELECT d.r, d.doc_id, d.w, b.* EXCLUDE (r) FROM d LEFT JOIN b ON d.r = b.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS "start", best.l::BIGINT AS "length", best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
 sha256(array_to_string(CASE WHEN runs IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: len(list_filter(runs, lambda x: i >= x.s + x.p AND i < x.s + x.l)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256 FROM k""",
}

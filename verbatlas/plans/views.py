"""The supplied tables as corpora: units, occurrences and editions in both engines' terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators.ranks import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units, row by row."""
    section = F.substring("source", 4, 10).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("unit_id"), section.alias("section_id"), F.when(F.col("lang") == "en", "A").otherwise("B").alias("cohort"), (section * 7 % 20 + 1).alias("ordinal"), F.size(X.words(F.col("text"))).alias("n_words"), "text",
    )


def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, unit_num, block_id: the place of each document in its section, from ids alone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.substring("source", 4, 10).cast("int").alias("s"))
    return numbered(d, "s", "unit_id", "unit_num").select("unit_id", "unit_num", F.floor((F.col("unit_num") - 1) / 10).cast("int").alias("block_id"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_units(spark, sf_dir).join(numbering(spark, sf_dir), "unit_id")


def occurrences(units_frame: DataFrame) -> DataFrame:
    """A row for each word with its unit's columns but the text."""
    rest = [c for c in units_frame.columns if c != "text"]
    return units_frame.select(*rest, F.posexplode(X.words(F.col("text"))).alias("_p", "term")).withColumn("position", F.col("_p") + 1).drop("_p")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences: unit = order, term = brand, lemma = type, section = nation, block = month of the order."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), "l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("block_id"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("section_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "A").otherwise("B").alias("cohort"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("term"), F.col("p_type").alias("lemma"))
    return line.join(order, "unit_id").join(customer, "o_custkey").join(part, "l_partkey").drop("o_custkey", "l_partkey")


def basket_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("block_id"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("section_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "A").otherwise("B").alias("cohort"))
    return order.join(customer, "o_custkey").drop("o_custkey")


#: The same views for DuckDB: u (units), w (occurrences), b (baskets), bu (basket units).
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
U = rf"""u AS (SELECT doc_id AS unit_id, cast(substr(source, 4) AS int) AS section_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS cohort,
  cast(substr(source, 4) AS int) * 7 % 20 + 1 AS ordinal, text, {TOKENS} AS tokens, len({TOKENS}) AS n_words,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS unit_num, cast((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS int) AS block_id FROM documents)"""
W = "w AS (SELECT unit_id, section_id, cohort, ordinal, unit_num, block_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS position FROM u)"
B = """b AS (SELECT l_orderkey AS unit_id, l_returnflag AS flag, l_linestatus AS status, p_brand AS term, p_type AS lemma, c_nationkey AS section_id, strftime(o_orderdate, '%Y-%m') AS block_id,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'A' ELSE 'B' END AS cohort
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
BU = """bu AS (SELECT o_orderkey AS unit_id, c_nationkey AS section_id, strftime(o_orderdate, '%Y-%m') AS block_id,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'A' ELSE 'B' END AS cohort FROM orders JOIN customer ON o_custkey = c_custkey)"""
#: Exact binomial tails for DuckDB: pass k, n, p as SQL; needs lgamma.
LPMF = "(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"


def p_value(k: str, n: str, p: str) -> str:
    """SQL for the doubled tail of k successes in n at rate p."""
    pmf = LPMF.format(n=f"({n})::DOUBLE", p=f"({p})")
    up = f"(SELECT sum(exp({pmf})) FROM generate_series(({k})::BIGINT, ({n})::BIGINT) AS g(i))"
    down = f"(SELECT sum(exp({pmf})) FROM generate_series(0::BIGINT, ({k})::BIGINT) AS g(i))"
    return f"CASE WHEN ({n}) <= 0 THEN 1.0 WHEN ({p}) <= 0 OR ({p}) >= 1 THEN 1.0 WHEN ({k}) >= ({n}) * ({p}) THEN least(1.0, 2 * {up}) ELSE least(1.0, 2 * {down}) END"


def tails(rows: str, keys: str) -> str:
    """SQL (CTEs ``_terms`` and ``tails``) for the doubled tails of all rows (keys, n, k, rate) at once: a row for each outcome on the observed side, summed by row.

    All the outcomes are as many as all trials, so a whole sweep costs no more than its occurrences.
    """
    up = "k >= n * rate"
    pmf = LPMF.format(n="n::DOUBLE", p="rate")
    return f"""_terms AS (SELECT *, unnest(generate_series(CASE WHEN {up} THEN k ELSE 0 END::BIGINT, CASE WHEN {up} THEN n ELSE k END::BIGINT)) AS i FROM {rows} WHERE n > 0 AND rate > 0 AND rate < 1),
tails AS (SELECT {keys}, any_value(n) AS n, any_value(k) AS k, any_value(rate) AS rate, least(1.0, 2 * sum(exp({pmf}))) AS p FROM _terms GROUP BY {keys})"""

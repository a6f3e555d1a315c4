"""A training-data pipeline over ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.decontamination import contaminated
from verbatlas.llm.jaccard import jaccard_groups
from verbatlas.llm.language import identify_held_out
from verbatlas.llm.mixing import mix_to_targets
from verbatlas.llm.sharding import assign_shards, number_slots
from verbatlas.sources.shared import stash

N_SHARDS = 8


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row's whole content, under which rows are decided: ids may be null or repeat.

    Rows with one key are equal in every column.
    """
    columns = [F.col(c) for c in docs.columns]
    present = [F.col(c).isNull() for c in docs.columns]
    return docs.withColumn("_key", F.concat(*[F.hex(F.xxhash64(F.lit(i), *columns, *present)) for i in (1, 2)]))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those too far from every language, or without letters, go.

    Each row is decided by itself, whatever its id.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]  # apart from the names of what is found
    whole = docs.select("doc_id", "lang", *[F.col(c).alias(name) for c, name in zip(docs.columns, own, strict=True)])
    found = identify_held_out(whole, keep=tuple(own), text_col=own[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*[F.col(name).alias(c) for c, name in zip(docs.columns, own, strict=True)])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows are compared whatever their id; a row without id stays only if its group has none with one. Of equal rows
    one stays. Documents without words are no copies of anything and all stay.
    """
    docs = keyed(docs)
    groups = jaccard_groups(docs.select("_key", "text"), width=5, num=80, den=100, id_col="_key")
    rows = groups.groupBy("_key").agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("_words"), F.count("*").alias("_n"))
    ids = docs.groupBy("_key").agg(F.first("doc_id").alias("doc_id"))
    rows = rows.join(ids, "_key").withColumn("_group", F.when(F.col("_words") > 0, F.col("component")).otherwise(F.col("_key")))
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key")))
    kept = rows.groupBy("_group").agg(least.alias("_least")).select(F.col("_least._key").alias("_key"))
    kept = stash(rows.join(kept, "_key").select("_key", ((F.col("_n") > 1) & (F.col("_words") > 0)).alias("_many")), "pipeline-kept")
    found = docs.join(kept, "_key")
    once = found.where("_many").dropDuplicates(["_key"])
    return found.where("NOT _many").unionByName(once).select([c for c in docs.columns if c != "_key"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; each row is decided by its own text, whatever its id."""
    rows = keyed(docs)
    found = contaminated(rows.select("_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select("_key").distinct()
    return rows.join(found, "_key", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes of a document; documents that it takes none of go.

    Equal rows are drawn one by one, and their copies come from one of them.
    """
    rows = keyed(docs)
    taken = mix_to_targets(rows.select("_key", "source", "text"), id_col="_key").groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")).where("_copies > 0")
    found = rows.join(taken, "_key")
    found = found.where("_n = 1").unionByName(found.where("_n > 1").dropDuplicates(["_key"]))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy with its shard and its place in it; groups of equal texts stay in one shard."""
    slim = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = number_slots(assign_shards(slim, N_SHARDS), "doc_id", "text_crc32")
    return placed.select("doc_id", "source", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [("language", language_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Classifier and spaced hashes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; a table in the shared folder stands between two stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

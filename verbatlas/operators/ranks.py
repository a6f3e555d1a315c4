"""Global order without one task: ranks and running sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.sources.shared import stash


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column] | None = None, rank: str = "_rank") -> DataFrame:
    """``rows`` with a rank from 1 in the given order, and running sums up to each row (it included).

    Rows are dealt by ranges of the order, ranked inside each range, and shifted by what lies in the ranges before; those totals are one
    row a range, as many as the shuffle has partitions. Ties are broken arbitrarily unless ``order`` decides them; give it a last
    column that does, also because equal keys share a range. Null keys stand where the order puts them. An empty table stays empty.
    """
    sums = sums or {}
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    placed = stash(rows.withColumns({f"_s_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumns({rank: F.row_number().over(inside), **{f"_r_{n}": F.sum(f"_s_{n}").over(upto) for n in sums}})
    out = ranked.join(F.broadcast(offsets), "_part")
    return out.withColumns({rank: F.col(rank) + F.col("_n"), **{n: F.col(f"_r_{n}") + F.col(f"_t_{n}") for n in sums}}).drop("_part", "_n", *keys, *[f"_{k}_{n}" for n in sums for k in "str"])


def numbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 inside each ``group`` by ``order``, without gathering a group in one task.

    Ranks over (group, order) as a whole, less the rows of the groups before, which are counted: one row for each group. A null group is a group; it comes first.
    """
    ranked = running(rows, [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()])
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_group", "_first", "_rank")


def suffix_minimum(rows: DataFrame, value: Column, rank: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` at this rank or a later one; like ``running``, from the end."""
    placed = stash(rows.withColumn("_v", value).repartitionByRange(F.col(rank)).withColumn("_part", F.spark_partition_id()), "suffix")
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    later = placed.groupBy("_part").agg(F.min("_v").alias("_least")).select("_part", F.min("_least").over(after).alias("_later"))
    inside = Window.partitionBy("_part").orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_own", F.min("_v").over(inside)).join(F.broadcast(later), "_part")
    return out.withColumn(name, F.least("_own", "_later")).drop("_part", "_v", "_own", "_later")

"""Sharding by minimax contiguous partition over atomic groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.sources.shared import stash

#: Group keys are the first 60 bits of the text's MD5, so that any engine can repeat the order.
KEY_BITS = 60
#: Bits that the first pass and each later pass of the prefix-sum refinement resolve.
FIRST_BITS, NEXT_BITS = 12, 10
#: Cells of a shard in which slots are counted; offsets are prefix sums over cells.
SLOT_CELLS = 1024


def group_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


class PrefixSums:
    """Prefix sums over ordered groups, known cell by cell; a cell is a key range of one or more groups.

    Holds a bounded number of cells (2**FIRST_BITS, then 2**NEXT_BITS for each of the few cells
    that may hold a cut), never one entry for each group.
    """

    def __init__(self, cells: list[tuple[int, int, int, bool]]):
        self.cells = cells  # (first key, last key, bytes, whether it is one group), by key
        self.ends = list(accumulate(c[2] for c in cells))
        self.total = self.ends[-1] if cells else 0

    def reach(self, x: int, hopeful: bool) -> int:
        """The largest group boundary not above x: a lower bound, or an upper one if ``hopeful``."""
        at = bisect_right(self.ends, x)
        if at == len(self.ends):
            return self.total
        low = self.ends[at - 1] if at else 0
        return x if hopeful and not self.cells[at][3] else low

    def chain(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        ends, at = [], 0
        for _ in range(shards):
            at = self.reach(at + capacity, hopeful)
            ends.append(at)
        return ends

    def smallest(self, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity whose greedy filling takes everything."""
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.chain(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_cells(self, shards: int) -> tuple[int, list[int]]:
        """The smallest capacity as far as it is known, and the cells that must be resolved to know it."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        first, last = [0, *self.chain(low, shards, False)], [0, *self.chain(high, shards, True)]
        found = set()
        for a, b in zip(first[:-1], last[:-1], strict=True):
            for i in range(bisect_right(self.ends, a + low), min(bisect_right(self.ends, b + high) + 1, len(self.cells))):
                if not self.cells[i][3]:
                    found.add(i)
        return low, sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest shard capacity and the last key of each filled shard, for ``groups`` (key, bytes) in key order.

    The driver binary-searches over prefix sums; a Spark job for each level of refinement sums
    only the cells in which a cut may fall, until every cut lies between two known groups.
    """

    def sums(frame: DataFrame, shift: int) -> list[tuple[int, int, int, bool]]:
        rows = (
            frame.groupBy(F.shiftright("key", shift).alias("cell"))
            .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
            .collect()
        )
        return sorted((r["first"], r["last"], r["bytes"], r["n"] == 1) for r in rows)

    shift = KEY_BITS - FIRST_BITS
    known = PrefixSums(sums(groups, shift))
    while True:
        capacity, unknown = known.open_cells(shards)
        if not unknown:
            break
        shift = max(0, shift - NEXT_BITS)
        wanted = F.lit(False)
        for i in unknown:
            wanted = wanted | F.col("key").between(known.cells[i][0], known.cells[i][1])
        gone = set(unknown)
        known = PrefixSums(sorted([c for i, c in enumerate(known.cells) if i not in gone] + sums(groups.where(wanted), shift)))
    cuts = []
    for end in known.chain(capacity, shards, False):
        at = bisect_right(known.ends, end) - 1
        if at >= 0 and (not cuts or known.cells[at][1] > cuts[-1]):
            cuts.append(known.cells[at][1])
    return capacity, cuts


def assign_shards(docs: DataFrame, n_shards: int, text_col: str = "text", size: Column | None = None) -> DataFrame:
    """``docs`` with ``shard`` in 0..n_shards-1 so that the largest shard is as small as possible.

    Groups of equal texts are atomic and ordered by the text's hash, so that a group of copies,
    however many rows it has, is one (key, bytes) row after partial aggregation. A group as large
    as an equal share of what is left gets a shard of its own (at most ``n_shards`` such groups are
    looked at): every partition has a shard at least as large, and the rest, cut at its own smallest feasible capacity, keeps
    shards near equal. Assignment is then an expression on the row itself, without a join.

    Null texts are treated as empty. An empty table gives an empty result.
    """
    size = size if size is not None else F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = stash(docs.withColumns({"_key": group_key(F.col(text_col)), "_bytes": size}).drop(text_col), "shard-rows")
    groups = stash(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("_bytes").alias("bytes")), "shard-groups")
    rest = groups.agg(F.sum("bytes")).first()[0] or 0
    own: list[int] = []
    for key, size_of in groups.orderBy(F.desc("bytes"), "key").limit(n_shards).collect():
        if len(own) == n_shards - 1 or size_of * (n_shards - len(own)) < rest:
            break
        own.append(key)
        rest -= size_of
    left = groups.where(~F.col("key").isin(own)) if own else groups
    _, cuts = minimax_cuts(left, n_shards - len(own))
    shard = F.lit(len(own))
    for cut in cuts[:-1]:
        shard = shard + (F.col("_key") > cut).cast("int")
    for i, key in enumerate(own):
        shard = F.when(F.col("_key") == key, i).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int")).drop("_key", "_bytes")


def number_slots(rows: DataFrame, id_col: str, tie: str) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard, without one task that holds a shard or a group of equal rows.

    Equal rows are counted first, task by task, so that a group of any size is a few counts. Counts fall into cells of a shard (about
    a million rows each, SLOT_CELLS at least), whose prefix sums (a bounded table) give offsets; each count is dealt out anew
    before it becomes rows again. Rows that agree in all columns are interchangeable.
    """
    columns = rows.columns
    cells = max(SLOT_CELLS, rows.count() // 1_000_000)
    counts = rows.withColumn("_part", F.spark_partition_id()).groupBy(*columns, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_cell", F.pmod(F.xxhash64(id_col, tie), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", F.pmod(F.xxhash64(id_col, tie), F.lit(cells)).cast("int").alias("_cell")).agg(F.count("*").alias("_all")).select("shard", "_cell", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_cell").orderBy(id_col, tie, "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, ["shard", "_cell"]).withColumn("_from", F.col("_before") + F.col("_at"))
    dealt = placed.select(*columns, "_from", "_n").repartition("_from", "shard")
    return dealt.withColumn("slot", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1))).select(*columns, "slot")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in one of ``n_shards`` shards of nearly equal bytes (law ``bytes``).

    Returns id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (of the UTF-8 bytes; of
    the empty text for null), law, shard, slot, grown_shard (null under this law). Extra columns of
    ``docs`` are ignored. Null and repeated ids are kept as they are, one row each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col), text.alias("_text"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = number_slots(assign_shards(slim, n_shards, "_text", F.col("size")), id_col, "text_crc32")
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

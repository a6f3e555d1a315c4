"""Derived edges and mined structures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.diffs import changes
from verbatlas.functions.text import bound, shingles
from verbatlas.operators.components import connected_components
from verbatlas.sources.shared import discard, stash, tidy


def term_counts(occurrences: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, occurrences, units; terms of a dictionary that never occur count 0."""
    counts = occurrences.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct("unit_id").alias("units"))
    if terms is None:
        return counts
    return terms.join(counts, "term", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("occurrences", "units")})


def packed_sets(items: DataFrame, key: str = "unit_id", item: str = "item") -> DataFrame:
    """k, s: each set once, as a sorted array of 64-bit hashes of its items (numbers of 64 bits stand for themselves)."""
    code = F.col(item) if dict(items.dtypes)[item] == "bigint" else F.xxhash64(item)
    return items.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_set(code)).alias("s"))


#: Bits of the filter of items that more than one set may hold (by the head of their hash), and items that a task gathers before it sends their hashes on.
FILTER_BITS, GATHERED = 27, 2_000_000
_CODE = 40


def repeated_items(sets: DataFrame) -> np.ndarray:
    """Bits of a filter that has every item of more than one set (and others by chance; all, where there are very many).

    ``sets``: s, sorted arrays of distinct hashes. Hashes travel in 40 bits, sorted and packed; each part of their range makes its own stretch of the bits.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << _CODE) // parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            parted = np.split(codes, np.searchsorted(codes, edges))
            blobs = [pa.compress(np.diff(c, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) for c in parted]
            return pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "n": pa.array([len(c) for c in parted], pa.int64()), "codes": pa.array(blobs, pa.binary())})

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - _CODE))
            if sum(map(len, held)) >= GATHERED:
                yield packed()
                held.clear()
        if held:
            yield packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(j)[i].as_py() for j in range(3)) for batch in batches for i in range(batch.num_rows))
        for _, members in groupby(rows, key=itemgetter(0)):
            found = [np.cumsum(np.ascontiguousarray(np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64) for _, n, blob in members if n]
            codes = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            bits = (codes[1:][codes[1:] == codes[:-1]] >> np.uint64(_CODE - FILTER_BITS)).astype(np.int64)
            if len(bits):
                first = int(bits[0]) >> 3
                own = np.zeros((int(bits[-1]) >> 3) - first + 1, np.uint8)
                np.bitwise_or.at(own, (bits >> 3) - first, np.left_shift(1, bits & 7).astype(np.uint8))
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    sent = sets.select("s").mapInArrow(send, "part int, n long, codes binary")
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "first long, bits binary").toLocalIterator():  # as long as the filter, in all
        bits[row["first"] : row["first"] + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
    return bits


def without_own_items(sets: DataFrame) -> DataFrame:
    """``sets`` (k, s, n) less the items that one set alone holds, as far as the filter tells; n stays."""
    shared = sets.sparkSession.sparkContext.broadcast(repeated_items(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            at = (values.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            good = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            upto = np.concatenate([[0], np.cumsum(good)])
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(values[good])), batch.column(2)], names=["k", "s", "n"])

    return sets.select("k", "s", "n").mapInArrow(run, f"k {dict(sets.dtypes)['k']}, s array<bigint>, n int")


def similar_packed(sets: DataFrame, threshold: float, least_shared: int = 1, df_max: int | None = None, least_size: int = 1) -> DataFrame:
    """``similar_sets`` over packed sets (k, s); keys are unique.

    Items of one set alone cannot be shared, so only the others (a filter drops most of the rest beforehand) are joined, ordered by rarity and kept, and an unshared item still takes its place at the head of the order. A
    pair is a candidate if it shares an item among the rarest ones of both sides (as many as two similar sets cannot both do without), if sizes allow the threshold,
    and if the shared items so far and what is left behind the last of them can still reach it. Only candidates' shared items are sent to one another.
    """
    whole = stash(sets.where(F.size("s") >= least_size).select("k", "s", F.size("s").alias("n")), "packed-sets")
    sets = stash(without_own_items(whole), "shared-sets")
    discard(whole)
    tidy(sets.sparkSession)
    entries = sets.select("k", "n", F.explode("s").alias("i"))
    shared = entries.groupBy("i").agg(F.count("*").alias("df")).where("df > 1")
    order = F.array_sort(F.collect_list(F.struct("df", "i")))
    order = order if df_max is not None else F.transform(order, lambda x: x["i"])
    ranked = stash(entries.join(shared, "i").groupBy("k", "n").agg(order.alias("r")), "ranked-sets")
    discard(sets)
    tidy(sets.sparkSession)
    n, alone = F.col("n"), F.col("n") - F.size("r")
    code = (lambda x: x) if df_max is None else (lambda x: x["i"])
    if df_max is None:
        prefix = F.slice("r", 1, F.greatest(F.lit(0), n - F.ceil(n * threshold - 1e-9).cast("int") + 1 - alone))
    else:
        prefix = F.filter("r", lambda x: x["df"] <= df_max)
    listed = ranked.select("k", "n", alone.alias("alone"), F.posexplode(prefix).alias("p", "x")).select("k", "n", (F.col("p") + F.col("alone")).alias("p"), code(F.col("x")).alias("i"))
    left, right = (listed.select("i", F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "12")
    # Sets whose sizes differ too much cannot reach the threshold.
    close = (F.col("n1") >= threshold * F.col("n2") - 1e-9) & (F.col("n2") >= threshold * F.col("n1") - 1e-9)
    met = left.join(right, "i").where((F.col("k1") < F.col("k2")) & close)
    seen = met.groupBy("k1", "k2", "n1", "n2").agg(F.count("*").alias("c"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    if df_max is None:  # with a cap the items between two places may be shared though they are not listed
        need = F.greatest(F.lit(least_shared), F.ceil((F.col("n1") + F.col("n2")) * threshold / (1 + threshold) - 1e-9))
        seen = seen.where(F.col("c") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1 >= need)
    codes = ranked.select("k", F.transform("r", code).alias("s") if df_max is not None else F.col("r").alias("s"))
    a, b = codes.select(F.col("k").alias("k1"), F.col("s").alias("s1")), codes.select(F.col("k").alias("k2"), F.col("s").alias("s2"))
    scored = seen.select("k1", "k2", "n1", "n2").join(a, "k1").join(b, "k2").select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.size(F.array_intersect("s1", "s2")).alias("shared"), F.col("n1").alias("size_a"), F.col("n2").alias("size_b"))
    scored = scored.withColumn("score", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return scored.where((F.col("score") >= threshold) & (F.col("shared") >= least_shared))


def similar_sets(items: DataFrame, threshold: float, least_shared: int = 1, df_max: int | None = None, least_size: int = 1, key: str = "unit_id", item: str = "item") -> DataFrame:
    """a, b (a < b), shared, size_a, size_b, score for pairs of sets with Jaccard at least ``threshold``.

    ``items``: key, item; repeated rows count once, rows without item are left out. Exact without ``df_max``: each set is indexed by its rarest items
    only, as many as two similar sets cannot both do without, so frequent items make no posting
    lists. With ``df_max`` candidates come from items in 2..df_max sets, and a pair that shares only
    more frequent ones is missed (``capped_items`` reports those). Scores count every shared item.
    """
    return similar_packed(packed_sets(items.where(F.col(item).isNotNull()), key, item), threshold, least_shared, df_max, least_size)


def equal_packed(sets: DataFrame) -> DataFrame:
    """key, rep, size, copies of packed sets (k, s): sets that are equal share a representative, their smallest key; told apart by size and two 64-bit hashes."""
    marks = sets.select(F.col("k").alias("key"), F.size("s").alias("size"), F.xxhash64("s").alias("_h1"), F.xxhash64(F.lit("second"), "s").alias("_h2"))
    groups = marks.groupBy("size", "_h1", "_h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    return marks.join(groups, ["size", "_h1", "_h2"]).select("key", "rep", "size", "copies")


def packed_groups(sets: DataFrame, threshold: float, least_shared: int = 1, df_max: int | None = None, least_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(membership as of ``equal_packed``, pairs of representatives as of ``similar_packed``) of packed sets (k, s); they are made once.

    Copies are never paired with one another: a group of m copies is m rows of membership. No link between different sets is lost.
    """
    sets = stash(sets, "all-sets")
    members = stash(equal_packed(sets), "set-groups")
    copies = members.where("key <> rep").select(F.col("key").alias("k"))
    pairs = similar_packed(sets.join(copies, "k", "left_anti"), threshold, least_shared, df_max, least_size)
    discard(sets)
    return members, pairs


def similar_groups(items: DataFrame, threshold: float, least_shared: int = 1, df_max: int | None = None, least_size: int = 1, key: str = "unit_id", item: str = "item") -> tuple[DataFrame, DataFrame]:
    """``packed_groups`` of a table of items (key, item)."""
    return packed_groups(packed_sets(items.where(F.col(item).isNotNull()), key, item), threshold, least_shared, df_max, least_size)


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs a < b of members, copies with one another too: m squared rows of m copies, for callers who want that list."""
    side = members.select("rep", F.col("key").alias("k"), "size")
    equal = side.join(side.select("rep", F.col("k").alias("l")), "rep").where(F.col("k") < F.col("l")).select(F.col("k").alias("a"), F.col("l").alias("b"), F.col("size").cast("int").alias("shared"), F.col("size").cast("int").alias("size_a"), F.col("size").cast("int").alias("size_b"), F.lit(1.0).alias("score"))
    left, right = side.select(F.col("rep").alias("a"), F.col("k").alias("ka")), side.select(F.col("rep").alias("b"), F.col("k").alias("kb"))
    met = pairs.join(left, "a").join(right, "b")
    flip = F.col("ka") < F.col("kb")
    both = met.select(F.when(flip, F.col("ka")).otherwise(F.col("kb")).alias("a"), F.when(flip, F.col("kb")).otherwise(F.col("ka")).alias("b"), "shared", F.when(flip, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(flip, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"), "score")
    return equal.unionByName(both)


def group_clusters(members: DataFrame, pairs: DataFrame, least: float = 0.75, least_size: int = 3) -> DataFrame:
    """unit_id, cluster (smallest member), size: like ``clusters``, from representatives and membership."""
    found = connected_components(pairs.where(F.col("score") >= least).select("a", "b"))
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("key").alias("unit_id"), F.coalesce("component", "rep").alias("cluster"))
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return labelled.join(sizes, "cluster").select("unit_id", "cluster", "size")


def group_summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row, like ``edge_summary`` over all pairs of members, counted without making them."""
    groups = stash(members.groupBy("rep").agg(F.max("copies").alias("n"), F.max("key").alias("hi")), "group-sizes")
    left, right = groups.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hi").alias("ha")), groups.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("hi").alias("hb"))
    met = stash(pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") * F.col("nb")).alias("n"), "score", "ha", "hb"), "group-pairs")
    counts = groups.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"), F.lit(1.0).alias("score")).unionByName(met.select("n", "score"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("score") == 1, F.col("n"))), F.lit(0)).alias("identical"), F.try_divide(F.sum(F.col("n") * F.col("score")), F.sum("n")).alias("mean_score"))
    reach = groups.select("rep", F.col("hi").alias("far")).unionByName(met.select(F.col("a").alias("rep"), F.col("hb").alias("far"))).unionByName(met.select(F.col("b").alias("rep"), F.col("ha").alias("far"))).groupBy("rep").agg(F.max("far").alias("far"))
    units = members.join(reach, "rep").agg(F.coalesce(F.sum((F.col("key") < F.col("far")).cast("long")), F.lit(0)).alias("units"))
    return one.join(F.broadcast(units))  # one-row sides


def capped_items(items: DataFrame, df_max: int, item: str = "item") -> DataFrame:
    """Items in more than ``df_max`` sets, with their number of sets; what a capped search leaves out."""
    return items.groupBy(item).agg(F.count("*").alias("df")).where(F.col("df") > df_max)


def shingle_items(units: DataFrame, tokens: Column, n: int, least_words: int) -> DataFrame:
    """unit_id, item: 64-bit hashes of the distinct n-grams of units with enough words; eight bytes shuffle better than words."""
    return shingle_sets(units, tokens, n, least_words).select(F.col("k").alias("unit_id"), F.explode("s").alias("item"))


def shingle_sets(units: DataFrame, tokens: Column, n: int, least_words: int) -> DataFrame:
    """k (unit), s: the sorted distinct 64-bit hashes of the n-grams of units with enough words, made within the row."""

    def of(h: Column) -> Column:
        # A run is a hash of its words' hashes; a shorter text is one run.
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - n)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= least_words, F.array_sort(F.array_distinct(runs)))

    return units.select(F.col("unit_id").alias("k"), bound(F.transform(tokens, lambda t: F.xxhash64(t)), of).alias("s")).where(F.size("s") > 0)


def near_duplicates(units: DataFrame, tokens: Column, threshold: float = 0.6, least_words: int = 4, n: int = 3, df_max: int | None = None, expand: bool = False) -> DataFrame:
    """Pairs of units whose n-gram sets have Jaccard at least ``threshold``, both directions, with word differences.

    only_a / only_b: the first 12 words of one side that the other lacks, in order; identical: equal word lists. Units with equal sets are represented by the smallest; ``duplicate_groups``
    has who stands for whom. With ``expand`` all pairs of units are listed instead, m squared rows of m copies; words are compared once for each pair of different texts.
    """
    members, pairs = duplicate_groups(units, tokens, threshold, least_words, n, df_max)
    if expand:
        texts = stash(equal_texts(units, tokens, least_words), "equal-texts")
        members = stash(members.join(texts.where("key = rep").select("key"), "key"), "set-groups")  # one for each text
        pairs = expanded(members, pairs)
    pairs = stash(pairs.select("a", "b", "shared", "score"), "duplicates")
    ends = pairs.select(F.col("a").alias("unit_id")).unionByName(pairs.select(F.col("b").alias("unit_id"))).distinct()
    words = units.join(ends, "unit_id", "left_semi").select("unit_id", tokens.alias("w"))
    met = pairs.join(words.select(F.col("unit_id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("unit_id").alias("b"), F.col("w").alias("wb")), "b")

    def lacking(x: str, y: str) -> Column:
        # The few words that the other side lacks come from a hashed difference, once for a pair.
        return bound(F.array_except(x, y), lambda d: F.when(F.size(d) > 0, F.slice(F.filter(F.col(x), lambda w: F.array_contains(d, w)), 1, 12)).otherwise(d))

    told = met.select("a", "b", "shared", "score", lacking("wa", "wb").alias("la"), lacking("wb", "wa").alias("lb"), (F.col("wa") == F.col("wb")).alias("identical"))
    ways = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(lx).alias("only_a"), F.col(ly).alias("only_b")) for x, y, lx, ly in (("a", "b", "la", "lb"), ("b", "a", "lb", "la"))]
    told = told.select("shared", "score", "identical", F.explode(F.array(*ways)).alias("_way")).select("_way.a", "_way.b", "shared", "score", "_way.only_a", "_way.only_b", "identical")
    return among_copies(told, members, texts) if expand else told


def equal_texts(units: DataFrame, tokens: Column, least_words: int) -> DataFrame:
    """key, rep, copies: units with enough words; equal word lists share a representative, their smallest unit."""
    words = F.transform(tokens, lambda t: F.xxhash64(t))
    marks = units.where(F.col("unit_id").isNotNull()).select(F.col("unit_id").alias("key"), words.alias("w")).where(F.size("w") >= least_words)
    marks = stash(marks.select("key", F.size("w").alias("n"), F.xxhash64("w").alias("_h1"), F.xxhash64(F.lit("second"), "w").alias("_h2")), "text-marks")
    groups = marks.groupBy("n", "_h1", "_h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    return marks.join(groups, ["n", "_h1", "_h2"]).select("key", "rep", "copies")


def among_copies(told: DataFrame, members: DataFrame, texts: DataFrame, block: int = 512) -> DataFrame:
    """``told`` (pairs of different texts, both directions) for all units with these texts, and the pairs of copies.

    ``members``: key, size of the set, one for each text. Copies stand in blocks, and pairs of blocks are dealt out, so no task lists a large group alone.
    """
    several = texts.where("copies > 1")
    none = F.array().cast("array<string>")
    same = members.join(several.where("key = rep").select("key"), "key").select(
        F.col("key").alias("a"), F.col("key").alias("b"), F.col("size").cast("int").alias("shared"), F.lit(1.0).alias("score"), none.alias("only_a"), none.alias("only_b"), F.lit(True).alias("identical")
    )
    blocks = several.groupBy("rep", F.expr(f"pmod(xxhash64(key), ceil(copies / {block}))").alias("block")).agg(F.collect_list("key").alias("keys"))
    blocks = stash(blocks, "copies")
    for side in "ab":
        own = blocks.select(F.col("rep").alias(side), F.col("block").alias(f"block_{side}"), F.col("keys").alias(f"keys_{side}"))
        told = (told.unionByName(same) if side == "a" else told).join(own, side, "left").withColumn(f"keys_{side}", F.coalesce(f"keys_{side}", F.array(side)))
    dealt = told.repartition("a", "b", "block_a", "block_b")
    rest = ("shared", "score", "only_a", "only_b", "identical")
    each = dealt.select(F.explode("keys_a").alias("a"), "keys_b", *rest).select("a", F.explode("keys_b").alias("b"), *rest)
    return each.where(F.col("a") != F.col("b"))


def duplicate_groups(units: DataFrame, tokens: Column, threshold: float = 0.6, least_words: int = 4, n: int = 3, df_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs of representatives) of near-duplicate units; units with too few words or a null text are in neither."""
    return packed_groups(shingle_sets(units, tokens, n, least_words), threshold, df_max=df_max)


def content_parallels(occurrences: DataFrame, threshold: float = 0.5, least_shared: int = 5, common: int = 400, least_size: int = 5, df_max: int | None = None) -> DataFrame:
    """Pairs of units that share content terms (those with at most ``common`` occurrences).

    Occurrences are counted by unit and term once; terms travel as hashes until pairs are known. Units with fewer than ``least_size`` such terms have no
    parallels; null terms and units count nowhere; repeated occurrences count towards ``common`` alone.
    """
    held = stash(occurrences.where("unit_id IS NOT NULL AND term IS NOT NULL").groupBy("unit_id", "term").agg(F.count("*").alias("n")), "unit-terms")
    frequent = held.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > common).select("term")  # the few, so they are what is joined
    items = held.join(frequent, "term", "left_anti").select("unit_id", F.col("term").alias("item"))
    pairs = stash(similar_sets(items, threshold, least_shared, df_max, least_size), "parallels")
    ends = pairs.select(F.col("a").alias("unit_id")).unionByName(pairs.select(F.col("b").alias("unit_id"))).distinct()
    sets = items.join(ends, "unit_id", "left_semi").groupBy("unit_id").agg(F.collect_set("item").alias("s"))
    out = pairs.join(sets.select(F.col("unit_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("unit_id").alias("b"), F.col("s").alias("sb")), "b")
    return out.select("a", "b", "shared", "score", F.array_sort(F.array_intersect("sa", "sb")).alias("shared_terms"), F.array_sort(F.array_except("sa", "sb")).alias("only_a"), F.array_sort(F.array_except("sb", "sa")).alias("only_b"))


def quote_links(documents: DataFrame, doc_tokens: Column, units: DataFrame, unit_tokens: Column, n: int = 5, doc_id: str = "doc_id", unit_id: str = "unit_id") -> DataFrame:
    """doc_id, unit_id, matched_runs, evidence: documents that hold an n-word run of a unit; evidence is the unit's last such run.

    Runs are hashed where they stand. Documents' hashes meet the units' distinct ones first, so only shared runs are made distinct and shuffled;
    Spark broadcasts those while they are few. Documents and units with fewer words, or null texts, have no runs; repeated ids count as one.
    """

    def grams(frame: DataFrame, key: str, tokens: Column, name: str, text: bool) -> DataFrame:
        def of(t: Column) -> Column:
            run = lambda i: F.array_join(F.slice(t, i, n), " ")
            return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.struct(F.xxhash64(run(i)).alias("h"), run(i).alias("gram")) if text else F.xxhash64(run(i))))

        return frame.select(F.col(key).alias(name), F.posexplode(bound(tokens, of)).alias("pos", "run"))

    own = grams(units, unit_id, unit_tokens, "unit_id", True).select("unit_id", "pos", "run.h", "run.gram")
    docs = grams(documents, doc_id, doc_tokens, "doc_id", False).select("doc_id", F.col("run").alias("h")).join(own.select("h").distinct(), "h", "left_semi").distinct()
    return docs.join(own, "h").groupBy("doc_id", "unit_id").agg(F.countDistinct("pos").alias("matched_runs"), F.max_by("gram", "pos").alias("evidence"))


def mine_conditionals(words: DataFrame, particles: Mapping[str, str]) -> DataFrame:
    """Condition and consequence of every conditional marker.

    ``words``: unit_id, position, text, term, is_verb, tag (COND, RSLT or null), form. A marker's
    span ends before the next one. It splits at the first RSLT inside (confidence 0.9), else at the
    second verb inside (0.5), else it is left out. The particle is looked up by form, and is the form itself where unknown.

    A span is named by its marker, the last one up to a word, which a running maximum within the unit gives, so each word is in one row: none is joined to spans. Words before the
    first marker belong to none. Of several markers at one position the first form by name counts; words with a null unit or position are left out; a unit
    without markers gives nothing.
    """
    upto = Window.partitionBy("unit_id").orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = words.where("unit_id IS NOT NULL AND position IS NOT NULL").select("unit_id", "position", "text", "term", "is_verb", "tag", F.when(F.col("tag") == "COND", F.coalesce("form", "text")).alias("_form"))
    marked = F.when(F.col("tag") == "COND", F.col("position"))
    counted = tagged.withColumn("_span", F.max(marked).over(upto)).where(F.col("_span").isNotNull())
    later = F.col("position") > F.col("_span")
    by_span = counted.groupBy("unit_id", F.col("_span").alias("start")).agg(
        F.min("_form").alias("form"), F.max("position").alias("_last"),
        F.min(F.when(later & (F.col("tag") == "RSLT"), F.col("position"))).alias("result"),
        F.array_sort(F.collect_list(F.when(later & F.col("is_verb"), F.col("position")))).alias("verbs"),
        F.array_sort(F.collect_list(F.struct("position", "text", "term"))).alias("w"),
    )
    order = Window.partitionBy("unit_id").orderBy("start")
    by_span = by_span.withColumn("stop", F.coalesce(F.lead("start").over(order), F.col("_last") + 1))
    split = by_span.withColumn("split", F.coalesce("result", F.when(F.size("verbs") >= 2, F.element_at("verbs", 2)))).where(F.col("split").isNotNull())
    before, after = F.filter("w", lambda x: x["position"] < F.col("split")), F.filter("w", lambda x: x["position"] >= F.col("split"))

    def terms(side: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(side, lambda x: x["term"]), lambda t: t.isNotNull())))

    particle = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in particles.items() for x in kv]), F.col("form")), F.col("form")) if particles else F.col("form")
    return split.select(
        "unit_id", particle.alias("particle"), F.col("form").alias("particle_form"), F.array_join(F.transform(before, lambda x: x["text"]), " ").alias("condition"), F.array_join(F.transform(after, lambda x: x["text"]), " ").alias("consequence"),
        terms(before).alias("condition_terms"), terms(after).alias("consequence_terms"), F.col("start").alias("word_start"), (F.col("stop") - 1).alias("word_end"), F.when(F.col("result").isNotNull(), 0.9).otherwise(0.5).alias("confidence"),
    )


def conditionals_within(units: DataFrame, tokens: Column, markers: Sequence[str], results: Sequence[str], verbs: str, particles: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``mine_conditionals`` where a row holds all words of its unit (``unit_id``, ``tokens`` in order; terms are the words): nothing is shuffled.

    ``markers`` are tagged COND, ``results`` RSLT, and words that match ``verbs`` are verbs. ``keep`` are further columns of the unit. A null id or array gives nothing.
    """

    def places(words: Column, good: Callable[[Column, Column], Column]) -> Column:
        return F.filter(F.transform(words, lambda x, i: F.when(good(x, i), i)), lambda i: i.isNotNull())

    def spans(t: Column) -> Column:
        return bound(places(t, lambda x, _: x.isin(*markers)), lambda at: F.transform(at, lambda i, k: F.struct((i + 1).alias("start"), F.slice(t, i + 1, F.coalesce(F.get(at, k + 1), F.size(t)) - i).alias("w"))))

    spanned = units.where(F.col("unit_id").isNotNull()).select("unit_id", *keep, F.explode(bound(tokens, spans)).alias("_s")).select("unit_id", *keep, "_s.start", "_s.w")
    found = spanned.withColumn("result", F.get(places(F.col("w"), lambda x, i: (i > 0) & x.isin(*results)), F.lit(0)))
    split = found.withColumn("split", F.coalesce("result", F.get(places(F.col("w"), lambda x, i: (i > 0) & x.rlike(verbs)), F.lit(1)))).where(F.col("split").isNotNull())
    form, n = F.col("w")[0], F.size("w")
    before, after = F.slice("w", F.lit(1), F.col("split")), F.slice("w", F.col("split") + 1, n)
    particle = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in particles.items() for x in kv]), form), form) if particles else form
    return split.select(
        "unit_id", *keep, particle.alias("particle"), form.alias("particle_form"), F.array_join(before, " ").alias("condition"), F.array_join(after, " ").alias("consequence"),
        F.array_sort(F.array_distinct(before)).alias("condition_terms"), F.array_sort(F.array_distinct(after)).alias("consequence_terms"), F.col("start").alias("word_start"), (F.col("start") + n - 1).alias("word_end"), F.when(F.col("result").isNotNull(), 0.9).otherwise(0.5).alias("confidence"),
    )


def seed_concepts(concepts: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``concepts``: slug, terms. Gives concept terms that occur, unresolved terms, and concept-unit weights."""
    wanted = concepts.select("slug", F.explode("terms").alias("term")).distinct()
    known = occurrences.select("term").distinct()
    linked = wanted.join(known, "term", "left_semi")
    units = occurrences.join(linked, "term").groupBy("slug", "unit_id").agg(F.count("*").alias("weight"))
    return linked, wanted.join(known, "term", "left_anti"), units


# -- similarity queries over pairs


def similar_to(edges: DataFrame, unit: int, least: float = 0.6, limit: int = 20) -> DataFrame:
    """The ``limit`` best edges (a, b, score) from a unit of at least ``least``; ties by b; none for an unknown unit."""
    return edges.where((F.col("a") == unit) & (F.col("score") >= least)).orderBy(F.desc("score"), "b").limit(limit)


def linked_unit(members: DataFrame, pairs: DataFrame) -> int | None:
    """The smallest unit that has an edge, to a copy or to another set, from membership and pairs of representatives."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    return members.where("copies > 1").select("key").unionByName(members.join(ends, "rep", "left_semi").select("key")).agg(F.min("key")).first()[0]


def group_edges(members: DataFrame, pairs: DataFrame, unit: int) -> DataFrame:
    """a (``unit``), b, score: the edges of one unit, to its copies and to all members of the sets that its own is paired with; no other pair is listed."""
    own = members.where(F.col("key") == unit).select(F.col("rep").alias("_own"))
    near = pairs.select(F.col("a").alias("_own"), F.col("b").alias("rep"), "score").unionByName(pairs.select(F.col("b").alias("_own"), F.col("a").alias("rep"), "score")).join(F.broadcast(own), "_own", "left_semi")
    near = near.select("rep", "score").unionByName(own.select(F.col("_own").alias("rep"), F.lit(1.0).alias("score")))
    return members.join(near, "rep").where(F.col("key") != unit).select(F.lit(unit).alias("a"), F.col("key").alias("b"), "score")


def word_diffs(pairs: DataFrame, a_words: str = "words_a", b_words: str = "words_b") -> DataFrame:
    """``pairs`` with edits, common and opcodes of the word-level changes, for surviving pairs only.

    ``edits``: words to delete and insert, as few as can be; ``common``: words of the longest common subsequence;
    ``opcodes``: array<struct<op, a, b>> of a shortest script (where several are shortest, one of them, the same on reruns).
    Work goes with the words times the edits. Null word lists count as empty; repeated rows are compared one by one.
    """
    keep = [c for c in pairs.columns if c not in (a_words, b_words)]
    kind = pa.list_(pa.struct([("op", pa.string()), ("a", pa.string()), ("b", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, common, ops = [], [], []
            for a, b in zip(batch.column(a_words).to_pylist(), batch.column(b_words).to_pylist(), strict=True):
                a, b = a or [], b or []
                found = changes(a, b)
                ops.append([{"op": op, "a": " ".join(a[i:j]), "b": " ".join(b[k:m])} for op, i, j, k, m in found])
                edits.append(sum(j - i + m - k for _, i, j, k, m in found))
                common.append((len(a) + len(b) - edits[-1]) // 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(edits, pa.int64()), pa.array(common, pa.int64()), pa.array(ops, kind)], names=[*keep, "edits", "common", "opcodes"])

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", edits long, common long, opcodes array<struct<op:string,a:string,b:string>>")


def clusters(edges: DataFrame, least: float = 0.75, least_size: int = 3) -> DataFrame:
    """unit_id, cluster (smallest member), size of components of edges at least ``least``, from ``least_size`` members on."""
    members = connected_components(edges.where(F.col("score") >= least).select("a", "b"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return members.join(sizes, "component").select(F.col("node").alias("unit_id"), F.col("component").alias("cluster"), "size")


def edge_summary(edges: DataFrame) -> DataFrame:
    """One row: pairs, identical ones, their mean score (null without pairs), and units with an edge."""
    return edges.agg(F.count("*").alias("pairs"), F.coalesce(F.sum((F.col("score") == 1).cast("int")), F.lit(0)).alias("identical"), F.avg("score").alias("mean_score"), F.countDistinct("a").alias("units"))

"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kept positions of each mask; the others are ignored. Every window of 12 words with up to 2 substitutions, and every
#: item of 10 or 11 words with one, contains one of them unharmed (checked exhaustively in the tests).
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 8))
#: Masks of shorter items, by their number of words: of 6 to 9 words one may be substituted, of fewer none.
SHORT: dict[int, tuple[int, ...]] = {3: (0, 1, 2), 4: (0, 1, 2, 3), 5: (0, 1, 2, 3, 4), 6: (0, 1, 3), 7: (0, 1, 3), 8: (0, 1, 3, 4), 9: (0, 1, 3, 4)}
#: A document overlaps an item where WINDOW aligned words have at least MATCHES equal ones.
WINDOW, MATCHES = 12, 10
#: Item hashes are broadcast up to this many rows (20 bytes each). Beyond it a filter of 2**FILTER_BITS words of 64 bits
#: is broadcast, and what passes it is shuffled, without texts.
BROADCAST_ROWS, FILTER_BITS = 500_000, 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


ALL_MASKS = (*MASKS, *dict.fromkeys(SHORT.values()))


def masks_of(n: Column) -> Column:
    """Numbers (in ALL_MASKS) of the masks for an item of ``n`` words; none under 3 words."""
    short = F.element_at(F.create_map(*[F.lit(x) for k, m in SHORT.items() for x in (k, ALL_MASKS.index(m))]), n)
    return F.when(n > max(SHORT), F.array(*[F.lit(i) for i in range(len(MASKS))])).when(short.isNotNull(), F.array(short)).otherwise(F.array().cast("array<int>"))


def seed_hash(tokens: Column, at: Column, mask: int) -> Column:
    """The masked hash of the words from position ``at``; null where the mask passes the end."""
    kept = ALL_MASKS[mask]
    return F.when(at + kept[-1] < F.size(tokens), F.xxhash64(F.lit(mask), *[F.get(tokens, at + F.lit(o)) for o in kept]))


def positions(frame: DataFrame, shortest: int, keep: Sequence[str]) -> DataFrame:
    """A row for each position of ``frame``'s ``tokens`` at which a mask of ``shortest`` words or more may start."""
    return frame.where(F.size("tokens") >= shortest).select(*keep, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - shortest)).alias("at"))


def item_seeds_of(side: DataFrame) -> DataFrame:
    """item, item_at, mask, seed of every item under the masks for its length."""
    at = positions(side.withColumn("masks", masks_of(F.size("tokens"))), 3, ["item", "masks"])
    seeds = at.select("item", "at", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.when(F.array_contains("masks", i), seed_hash(F.col("tokens"), F.col("at"), i)).alias("seed")) for i in range(len(ALL_MASKS))])).alias("x"))
    return seeds.select("item", F.col("at").alias("item_at"), "x.mask", "x.seed").where(F.col("seed").isNotNull())


def doc_seeds_of(docs: DataFrame, masks: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep``, tokens, at, seed for each position of ``docs`` and each of ``masks``."""
    at = positions(docs, min(ALL_MASKS[i][-1] + 1 for i in masks), keep)
    return at.select(*keep, "tokens", "at", F.explode(F.array(*[seed_hash(F.col("tokens"), F.col("at"), i) for i in masks])).alias("seed")).where(F.col("seed").isNotNull())


def passing(seeds: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """``seeds`` that may be among the items', by a broadcast table of bits; its size is bounded whatever the items."""
    cell, bit = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), F.shiftrightunsigned("seed", 58).cast("int")
    bits = item_seeds.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 58) as int))")).alias("bits"))
    return seeds.join(F.broadcast(bits), cell == F.col("cell")).where(F.getbit("bits", bit) == 1).drop("cell", "bits")


def best_window(doc: Column, item: Column, item_at: Column, reach: int) -> Column:
    """Most equal words in a window around a hit; ``doc`` holds the words from ``reach`` before it on."""
    span = 2 * reach + max(m[-1] for m in ALL_MASKS)
    equal = F.transform(F.sequence(F.lit(0), F.lit(span)), lambda i: F.coalesce((F.get(doc, i) == F.get(item, item_at + i - reach)).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(1), F.lit(span + 2 - WINDOW)), lambda s: F.aggregate(F.slice(equal, s, WINDOW), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it overlaps, substitutions allowed.

    Masks that ignore chosen word positions are hashed at every position of both sides; equal
    hashes are hits, and around each hit the aligned words are compared: at least 10 equal words in
    some window of 12 (of an item shorter than 12 words, the same share of all its words). No overlap of that kind is missed.
    Whole texts are searched. Words are case-folded runs of letters and digits.

    Few items (BROADCAST_ROWS hashes) are broadcast, and the texts stay where they are. Of many, a filter of bounded size
    is broadcast; positions that pass it are joined by hash without their texts, and only the hits meet the texts again, in one shuffle.

    Returns id, item id, first_word (smallest position of a verified hit), hits, matched, window.
    Items with fewer than 3 words tell no overlap from chance and are not searched; documents shorter than a mask, empty and null texts
    have no pairs. Rows that repeat an id, or lack one, are reported together. Extra columns are ignored.
    """
    reach = WINDOW - 1
    side = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col).cast("string")).alias("tokens"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc"), words(text).alias("tokens"))
    found_seeds = item_seeds_of(side)
    by_mask = {r["mask"]: r["n"] for r in found_seeds.groupBy("mask").agg(F.count("*").alias("n")).collect()}
    masks, item_seeds = sorted(by_mask) or [0], found_seeds.select("item", "item_at", "seed")
    # Words before the text's start are padded with null, so that the hit stands at index ``reach``.
    ahead = F.when(F.col("at") < reach, F.array_repeat(F.lit(None).cast("string"), F.lit(reach) - F.col("at"))).otherwise(F.array().cast("array<string>"))
    start = F.greatest(F.col("at") - reach, F.lit(0))
    stop = F.col("at") + reach + max(m[-1] for m in ALL_MASKS)
    around = F.concat(ahead, F.slice("tokens", start + 1, stop - start + 1)).alias("around")
    if sum(by_mask.values()) <= BROADCAST_ROWS:
        hits = doc_seeds_of(texts, masks, ["doc"]).join(F.broadcast(item_seeds), "seed").select("doc", "item", "at", "item_at", around)
    else:
        keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
        own = passing(doc_seeds_of(keyed.select("key", words(F.col("text")).alias("tokens")), masks, ["key"]).drop("tokens"), item_seeds)
        places = own.distinct().join(item_seeds, "seed").select("key", "item", "at", "item_at")
        hits = keyed.join(places, "key").select("doc", words(F.col("text")).alias("tokens"), "at", "item", "item_at").select("doc", "item", "at", "item_at", around)
    found = hits.join(side.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))).drop("_item")
    window = F.least(F.lit(WINDOW), F.size("tokens"))
    found = found.withColumns({"matched": best_window(F.col("around"), F.col("tokens"), F.col("item_at"), reach), "window": window})
    found = found.where(F.col("matched") >= F.ceil(F.col("window") * MATCHES / WINDOW))
    return found.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.min("at").cast("long").alias("first_word"), F.count("*").alias("hits"), F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))

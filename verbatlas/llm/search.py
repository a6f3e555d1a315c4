"""Ranked lexical search: the best documents for each of many items, by sums over short lists and skipping over long ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verbatlas.llm.batches import pack, unpack
from verbatlas.sources.shared import stash

#: Bytes of terms (digits, letters with A-Z as a-z, everything beyond ASCII); all others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A segment of the index ends at so many documents or bytes of text.
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 8 << 20
#: Documents in a block, for which each list keeps its largest contribution.
BLOCK = 64
#: A list is short where it holds at most one document in so many.
SHORT = 16
#: Bytes of item texts that are searched in one pass over the documents.
ITEM_BYTES = 8 << 20
_WIDTHS = (8, 4, 4)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def build_lists(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment of documents: n_docs (those with terms), n_terms, ids, terms, counts (documents that hold each), lists (packed lengths, places, occurrences).

    Only documents that hold a term of ``vocabulary`` are listed; the two totals count all. Nothing is shuffled.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fields = [T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("ids", T.ArrayType(slim.schema["id"].dataType)), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("lists", T.BinaryType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def segment(n_docs: int, n_terms: int, ids: list[pa.Array], held: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        lengths = np.array([n for n, _ in held], np.int64)
        where = np.repeat(np.arange(len(held)), [len(t) for _, t in held]).astype(np.int64)
        term = np.fromiter((x for _, t in held for x in t), np.int64, len(where))
        key, tf = np.unique(term * max(1, len(held)) + where, return_counts=True)
        terms, counts = np.unique(key // max(1, len(held)), return_counts=True)
        lists = pack([(lengths, 8), (key % max(1, len(held)), 4), (tf, 4)])
        own = pa.concat_arrays(ids) if ids else pa.array([], arrow.field("ids").type.value_type)
        columns = [[n_docs], [n_terms], pa.ListArray.from_arrays([0, len(own)], own), [terms.tolist()], [counts.tolist()], [lists]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = size = 0
        ids, held = [], []
        for batch in batches:
            kept = []
            for i, raw in enumerate(batch.column(1)):
                text = raw.as_py()
                words = terms_of(text)
                size += len(text or b"")
                n_docs += bool(words)
                n_terms += len(words)
                if own := [vocabulary[w] for w in words if w in vocabulary]:
                    kept.append(i)
                    held.append((len(words), own))
                if size >= SEGMENT_BYTES or len(held) >= SEGMENT_DOCS:
                    yield segment(n_docs, n_terms, [*ids, batch.column(0).take(pa.array(kept, pa.int64()))], held)
                    n_docs = n_terms = size = 0
                    ids, held, kept = [], [], []
            ids.append(batch.column(0).take(pa.array(kept, pa.int64())))
        if n_docs:
            yield segment(n_docs, n_terms, ids, held)

    return slim.mapInArrow(run, schema)


class Segment:
    """Lists of one segment with what each entry contributes, and the largest contribution in each block."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, lists: bytes, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        lengths, self.places, tf = (x.astype(np.int64) for x in unpack(lists, _WIDTHS))
        self.size = len(lengths)
        m = 50 + 50 * lengths * n_docs // n_terms
        self.gain = np.repeat(weight[terms], counts) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.places]))
        stops = np.cumsum(counts)
        self.spans = dict(zip(terms.tolist(), zip((stops - counts).tolist(), stops.tolist(), strict=True), strict=True))
        self.blocks = -(-self.size // BLOCK)
        self.tops: dict[int, np.ndarray] = {}

    def top(self, term: int) -> np.ndarray:
        """The largest contribution of ``term`` in each block."""
        if term not in self.tops:
            a, b = self.spans[term]
            out = np.zeros(self.blocks, np.int64)
            np.maximum.at(out, self.places[a:b] // BLOCK, self.gain[a:b])
            self.tops[term] = out
        return self.tops[term]

    def search(self, terms: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that score ``least`` or more (and above 0).

        Short lists are summed term by term into accumulators, which then count as one list with a bound for each block. Long lists are met document by
        document: blocks whose bounds add up to less than ``least`` are skipped, and a document goes as soon as what it has and what may still come is less.
        """
        least = max(least, 1)
        own = sorted((t for t in terms if t in self.spans), key=lambda t: self.spans[t][1] - self.spans[t][0])
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        long = []
        for t in own:
            a, b = self.spans[t]
            if (b - a) * SHORT <= self.size:
                sums[self.places[a:b]] += self.gain[a:b]
            else:
                long.append(t)
        bound = np.zeros(self.blocks, np.int64)
        for t in long:
            bound += self.top(t)
        open_blocks = np.flatnonzero(sums.reshape(-1, BLOCK).max(1) + bound >= least)
        at = (open_blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rest = np.repeat(bound[open_blocks], BLOCK)
        score = sums[at]
        for t in sorted(long, key=lambda t: -int(self.top(t).max())):
            alive = score + rest >= least
            at, score, rest = at[alive], score[alive], rest[alive]
            if not len(at):
                break
            a, b = self.spans[t]
            places = self.places[a:b]
            found = np.minimum(np.searchsorted(places, at), b - a - 1)
            score = score + np.where(places[found] == at, self.gain[a:b][found], 0)
            rest = rest - self.top(t)[at // BLOCK]
        good = score >= least
        return at[good], score[good]


def _best(scores: pa.Array, ids: pa.Array, k: int) -> tuple[pa.Array, pa.Array]:
    """The k highest scores, ties by id, null ids last."""
    table = pa.table({"score": scores, "id": ids})
    order = pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")[:k]
    return scores.take(order), ids.take(order)


def _search_block(docs: DataFrame, items: list[tuple[str, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """_key, id, score: each task's k best documents for each item."""
    vocabulary: dict[bytes, int] = {}
    wanted = [(key, [vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms)]) for key, terms in items]
    index = stash(build_lists(docs, vocabulary, id_col, text_col), "search-lists")
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in held.collect():  # a row for each term of this block of items
        weight[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[pa.Array, pa.Array] | None] = [None] * len(wanted)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, terms, counts = (batch.column(i)[row].values for i in range(3))
                found = Segment(terms.to_numpy(), counts.to_numpy(), batch.column(3)[row].as_py(), weight, n_docs, n_terms)
                if not found.size:
                    continue
                for q, (_, own) in enumerate(wanted):
                    now = best[q]
                    places, scores = found.search(own, now[0][-1].as_py() if now and len(now[0]) == k else 1)
                    if len(places):
                        more = pa.array(scores), ids.take(pa.array(places))
                        best[q] = _best(*(pa.concat_arrays([a, b]) for a, b in zip(now, more, strict=True)) if now else more, k)
        for (key, _), now in zip(wanted, best, strict=True):
            if now:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(now[0]), pa.string()), now[1].cast(arrow.field("id").type), now[0]], schema=arrow)

    return index.select("ids", "terms", "counts", "lists").mapInArrow(run, schema)


def search_items(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank (from 1), id, score: the ``k`` documents with the highest score above 0 for each row of ``items``, ties by ascending id.

    With N documents that hold a term, L terms in all and df documents that hold a term of the item, the term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a
    document of n terms has m = 50 + 50 n N div L, and scores w * (10^9 tf div (1000 tf + 20 m)) for each different term of the item that it holds.

    Every row of ``docs`` is a document of its own: repeated ids and texts all count, and a null id comes after all others of its score. A null or
    empty text holds no terms; an item without any finds nothing; rows of ``items`` with one text find the same, under their own ids. Empty tables give no rows.

    Items are taken in blocks of about ``ITEM_BYTES``, so the terms that travel to the tasks are bounded; a block costs one pass over the texts, which leaves lists of its terms
    in the shared folder, and one over those lists. Tasks send k rows an item.
    """
    asked = items.select(F.col(item_col).alias("_item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_key", F.sha2("_text", 256))
    texts = asked.select("_key", "_text").distinct()
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    found = None
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block).collect()  # about ITEM_BYTES
        part = _search_block(docs, [(r["_key"], terms_of(r["_text"].encode())) for r in sorted(rows)], k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    best = [F.desc("score"), F.col("id").asc_nulls_last()]
    found = found.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(256)))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(*best))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("_key").orderBy(*best))).where(F.col("rank") <= k)
    return asked.select("_key", "_item").join(ranked, "_key").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")

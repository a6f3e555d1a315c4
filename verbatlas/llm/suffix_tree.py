"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.batches import let_go, mixed, pack, text_groups, unpack, word_hashes
from verbatlas.sources.shared import discard, stash, tidy

_U = np.uint64
#: Hashes that stand for the begin of a text (a context only) and for its end (a token).
BEGIN, END = _U(0x7F4A7C15F39CC060), _U(0x106AA07032BBD1B8)
#: Shares of all tokens that bound what is broadcast: words and grams of at least SHARE (1 / SHARE of each
#: length at most). All others are joined; the share changes no score.
SHARE = 2.0**-21
#: Most words of a context.
DEPTH = 3
#: How often a context must be seen, and a word after it, by the number of words of the context (the last also for longer ones); the same at any input size.
LEAST_CONTEXT, LEAST_NEXT = (0, 2, 8, 8, 8), (0, 2, 3, 3, 3)
#: A word seen twice after a context is kept if the root expects it so seldom that its likelihood gains so many nats.
NEXT_GAIN = 8.0
#: A state is kept if its next words diverge from its parent's by so many nats a token, and by more than chance.
LEAST_DIVERGENCE, CHANCE = 0.01, 3.0
#: Weight of the parent's distribution in a state's, in tokens.
SMOOTHING = 5.0
#: Positions that a task holds before it counts and sends them on, and tokens for each part of a join.
FLUSH, PART_TOKENS = 400_000, 1_000_000
#: Words and grams of texts that a task holds before it sends them to the join.
POSTINGS = 150_000
#: Of a part's words and grams, how many meet its model at a time.
MET = 100_000
#: Bits of a hash by which grams, and single words as grams, are told apart (as words they have 64).
KEY, WORD_KEY = _U((1 << 48) - 1), _U((1 << 40) - 1)
#: Set in a gram's key where words' hashes stand beside it.
GRAM = _U(1 << 63)
#: Bits of a filter of keys; one that is full lets all keys pass, to the exact joins.
FILTER_BITS, FILTER_SHIFTS = 27, (0, 7, 13)
#: Texts (as a power of two) whose sums come back together.
GROUP_BITS = 14
_BLOCK = 15


def least_of(floors: tuple[int, ...], words: int) -> int:
    """The floor for a context of so many words."""
    return floors[min(words, len(floors) - 1)]


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of some texts between a begin and an end each, their places in the text, and the texts' sizes."""
    words, counts = word_hashes([t or b"" for t in texts])
    sizes = counts + 2
    starts = np.cumsum(sizes) - sizes
    out, inner = np.empty(int(sizes.sum()), np.uint64), np.ones(int(sizes.sum()), bool)
    for at, mark in ((starts, BEGIN), (starts + sizes - 1, END)):
        out[at], inner[at] = mark, False
    out[inner] = words
    return out, np.arange(len(out)) - np.repeat(starts, sizes), sizes


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of single words as grams."""
    return mixed(hashes + _U(0x632BE59BD9B4E019)) & WORD_KEY


def pair_keys(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the gram that starts with one gram and ends with another, each a word shorter."""
    return mixed(prefix * _U(0x9E3779B97F4A7C15) + suffix) & KEY


def longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the grams a word longer that end at the same places; the first place has none."""
    out = np.zeros_like(keys)
    out[1:] = pair_keys(keys[:-1], keys[1:])
    return out


def totals(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each, and how often it occurs (or its sum of ``n``)."""
    order = np.argsort(keys)
    ranked = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, n.dtype)
    return ranked[at], order[at], sums


class Table:
    """Places of uniform keys by their low bits: a lookup reads one short run, where a binary search would read a dozen places."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, len(keys).bit_length() + 1)
        self.mask = _U(size - 1)
        slot = keys & self.mask
        self.order = np.argsort(slot)
        self.keys = keys[self.order]
        self.start = np.searchsorted(slot[self.order], np.arange(size + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the array that made the table, -1 if it is not there."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        slot = (keys & self.mask).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end, keys = at[todo], end[todo], keys[todo]
        while len(todo):
            same = self.keys[at] == keys
            out[todo[same]] = self.order[at[same]]
            at = at + 1
            left = np.flatnonzero(~same & (at < end))
            todo, at, end, keys = todo[left], at[left], end[left], keys[left]
        return out


class KeyFilter(NamedTuple):
    """A set of keys with false hits, of one size for any number of keys; each key sets three bits, which other parts of it name."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for shift in FILTER_SHIFTS:
            at = (keys[left] >> _U(shift)) & _U((1 << FILTER_BITS) - 1)
            good = (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0
            found[left[~good]] = False
            left = left[good]
        return found


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of a one-column table of keys; blocks of bits are made in Spark."""
    keys = keys.coalesce(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(keys.columns[0])
    keys = keys.select(F.explode(F.array(*[F.shiftrightunsigned(key, n).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for n in FILTER_SHIFTS])).alias("at"))
    at = F.col("at")
    blocks = keys.select(F.shiftright(at, _BLOCK).alias("block"), at.bitwiseAND(F.lit((1 << _BLOCK) - 1)).alias("bit"))
    found = blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bits = np.zeros((1 << (FILTER_BITS - _BLOCK), 1 << (_BLOCK - 3)), np.uint8)
    for block, own in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[block] = np.frombuffer(own, np.uint8)
    return KeyFilter(bits.reshape(-1))


class SuffixTree:
    """The frequent head of the model: words and grams that every task knows, and a filter of all grams and words.

    A gram's value is the sum of two: what its last word gains, in log10, over its parent's
    probability against the mere weight of the state before it, and the weight by which the parent's
    probability is scaled if the gram is a state and the next word is not kept there. A text's score
    is the root's plus the values of all its grams.
    """

    def __init__(self, tokens: int, distinct: int, hashes: np.ndarray, counts: np.ndarray):
        self.tokens, self.distinct = tokens, distinct
        #: Hashes of the frequent words, and their counts.
        self.hashes, self.counts, self.heads = hashes, counts, Table(hashes)
        #: Words of the longest gram, the frequent grams, their values.
        self.longest, self.grams, self.values = 0, Table(hashes[:0]), np.zeros(0)
        self.some: KeyFilter | None = None

    @property
    def mass(self) -> float:
        return float(self.tokens + self.distinct + 1)

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of each text: tokens, frequent known ones, log10 P by the root alone and by the whole tree, as far as the head goes.

        Words beyond the head count as unseen here. They, and other grams that may bear on a score, are the last value: text, and
        key (of a word its hash, of a gram with the bit GRAM).
        """
        h, place, sizes = sequences(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        token = place > 0
        at = self.heads.find(h)
        known = (at >= 0) & token
        base = np.full(len(h), -math.log10(self.mass))
        base[known] += np.log10(self.counts[at[known]] + 1.0)
        base[~token] = 0
        rare = np.flatnonzero(token & ~known & (self.some.has(h) if self.some else False))
        missed = [(text[rare], h[rare])]
        gain = np.zeros(len(texts))
        keys, here = word_keys(h), np.arange(len(h))
        for n in range(1, self.longest + 1):
            if n > 1:
                keys = longer(keys)
                here = here[place[here] >= n - 1]
            here_now = here[self.some.has(keys[here])]
            own = keys[here_now]
            found = self.grams.find(own)
            got = found >= 0
            gain += np.bincount(text[here_now[got]], self.values[found[got]], len(texts))
            missed.append((text[here_now[~got]], own[~got] | GRAM))
            # A gram bears on no score unless the one without its first word does; a word may without.
            here = here_now if n > 1 else here
        by = lambda x: np.bincount(text, x, len(texts))
        roots = by(base)
        return sizes - 1, by(known).astype(np.int64), roots, roots + gain, tuple(np.concatenate(x) for x in zip(*missed, strict=True))


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """h, n over all tokens of ``train``; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in flushed(batches, lambda h, place: h[place > 0]):
            words, _, n = totals(h)
            yield pa.RecordBatch.from_pydict({"h": words.view(np.int64), "n": n})

    rows = train.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with the words' keys as grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_keys(h.view(np.uint64)).view(np.int64))], names=["h", "n", "key"])

    return vocabulary.select("h", "n").mapInArrow(run, "h long, n long, key long")


def flushed(batches: Iterator[pa.RecordBatch], work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Arrays (or stacked arrays) that ``work`` makes of groups of texts, joined until they hold FLUSH places."""
    held, n = [], 0
    for batch in batches:
        for group in text_groups(batch.column(0).to_pylist()):
            h, place, _ = sequences(group)
            held.append(work(h, place))
            n += held[-1].shape[-1]
            if n >= FLUSH:
                yield np.concatenate(held, axis=-1)
                held, n = [], 0
    if n:
        yield np.concatenate(held, axis=-1)
    del held
    let_go()


def parts_of(tokens: int, train: DataFrame) -> int:
    """Parts of a join by key: as many as the shuffle has partitions, more for large inputs, so that a part, which a task holds, is of bounded size."""
    return max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))


def dealt(sent: DataFrame, bucket: str, *order: Column) -> DataFrame:
    """Rows of a part next to one another, in the ``order`` given; a task takes its parts one after the other."""
    return sent.repartition(bucket).sortWithinPartitions(bucket, *order)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row by row, so that a batch of large values is not held twice."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def bucketed(bucket: np.ndarray, parts: int, columns: list[np.ndarray], packed: Callable[..., bytes]) -> tuple[list[int], list[bytes]]:
    """The buckets that have rows, and what ``packed`` makes of each one's rows of ``columns``, in the order given."""
    order = np.argsort(bucket.astype(np.uint16) if parts < 1 << 16 else bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    ranked = [c[order] for c in columns]
    return bucket[order[cut[:-1]]].tolist(), [packed(*(c[a:b] for c in ranked)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def packed_grams(suffix: np.ndarray, prefix: np.ndarray, n: np.ndarray) -> bytes:
    """Rows in the order of their suffixes, each of which is written once."""
    at = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
    return pack([(suffix[at], 6), (np.diff(np.append(at, len(suffix))), 4), (prefix, 6), (n, 5)])


def unpacked_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    suffix, sizes, prefix, n = unpack(blob, (6, 4, 6, 5))
    return np.repeat(suffix, sizes.astype(np.int64)), prefix, n.astype(np.int64)


def count_grams(train: DataFrame, text_col: str, tree: Broadcast, known: Broadcast, useful: Broadcast | None, length: int) -> DataFrame:
    """key, context, parent, n, expected of the grams of ``length`` words that may matter.

    ``context``: the gram without its last word; ``parent``: without its first (of rare pairs null). Pairs are counted if their last word passes
    the filter ``known``, longer grams if their context does and their parent passes ``useful``. Tasks count FLUSH places at a time and send the distinct grams packed, in one value for each part of the join;
    pairs meet at their last word, so that its count, and what the root expects, is known there (a frequent word's
    pairs are spread over all parts, its count comes with ``tree``).
    """
    parts = parts_of(tree.value.tokens, train)

    def grams(h: np.ndarray, place: np.ndarray) -> np.ndarray:
        shorter = word_keys(h)
        for _ in range(length - 2):
            shorter = longer(shorter)
        here = np.flatnonzero(place[1:] >= length - 1)
        here = here[known.value.has(shorter[here + (length == 2)])]
        if useful:
            here = here[useful.value.has(shorter[here + 1])]
        return np.stack([shorter[here], shorter[here + 1]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Table(word_keys(tree.value.hashes))
        for prefix, suffix in flushed(batches, grams):
            keys, at, n = totals(pair_keys(prefix, suffix))
            prefix, suffix = prefix[at], suffix[at]
            # Equal suffixes stand together, which packs them well; frequent ones are spread.
            meet = suffix * _U(31) + (prefix & _U(15)) if length > 2 else np.where(frequent.find(suffix) >= 0, keys, suffix)
            bucket = (mixed(meet) % _U(parts)).astype(np.int64)
            order = np.argsort(suffix)
            where, blobs = bucketed(bucket[order], parts, [suffix[order], prefix[order], n[order]], packed_grams)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(where, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        frequent, counts = Table(word_keys(t.hashes)), np.append(t.counts, 0)
        begin = word_keys(np.array([BEGIN]))
        for _, rows in groupby(rows_of(batches), key=itemgetter(0)):
            suffix, prefix, n = (np.concatenate(x) for x in zip(*(unpacked_grams(blob) for _, blob in rows), strict=True))
            keys, at, n = totals(pair_keys(prefix, suffix), n)
            prefix, suffix = prefix[at], suffix[at]
            expected = np.zeros(len(keys))
            if length == 2:
                words, _, own = totals(suffix, n)
                head = frequent.find(words)
                own = np.where(head >= 0, counts[head], own)
                expected = (own[np.searchsorted(words, suffix)] + 1) / t.mass
                head = frequent.find(prefix)
                least = np.where(head >= 0, counts[head], n)  # of the context: its count, or what is seen here
                least[prefix == begin] = n[prefix == begin]
                good = (n > 2) | (n == 2) & (gain_of(n, np.maximum(least, n) * expected) >= NEXT_GAIN)
            else:
                good = n >= least_of(LEAST_NEXT, length - 1)
            yield pa.RecordBatch.from_pydict({"key": keys[good].view(np.int64), "context": prefix[good].view(np.int64), "parent": pa.array(suffix[good].view(np.int64), mask=(n[good] < LEAST_CONTEXT[2]) & (length == 2)), "n": n[good], "expected": pa.array(expected[good].astype(np.float32))})
            del suffix, prefix, n, keys, at, expected, good, rows
            let_go()

    sent = train.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(send, "bucket long, blob binary")
    return dealt(sent, "bucket").mapInArrow(merge, "key long, context long, parent long, n long, expected float")


def gain_of(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Nats that ``n`` occurrences gain over an expected number, if that is smaller."""
    return np.where(n > expected, n * np.log(n / expected) - n + expected, 0.0)


def retained(rows: DataFrame) -> DataFrame:
    """context, kept, other (the parent's mass of the kept words): the contexts whose next words diverge from their parent state's.

    ``rows``: key, context, total, n, expected (the parent's probability), one for each kept next word.
    """
    p = F.col("n") / F.col("total")
    sums = rows.groupBy("context", "total").agg(F.sum("n").alias("kept"), F.sum("expected").alias("other"), F.sum(p * F.ln(p / F.col("expected"))).alias("gain"), F.count("key").alias("cells"))
    rest, rest_other = (F.least(F.greatest(1 - x, F.lit(1e-12)), F.lit(1.0)) for x in (F.col("kept") / F.col("total"), F.col("other")))
    chance = (F.col("cells") + CHANCE * F.sqrt(2.0 * F.col("cells"))) / (2.0 * F.col("total"))
    return sums.where(F.col("gain") + rest * F.ln(rest / rest_other) > F.greatest(F.lit(LEAST_DIVERGENCE), chance)).select("context", "kept", "other")


def fit_suffix_tree(train: DataFrame, text_col: str = "text", depth: int = DEPTH) -> tuple[SuffixTree, DataFrame]:
    """The frequent head of the model learnt from all of ``train``, and the rest of it as a table.

    The table's rows are (key, value, gram): the count of a word beyond the head under its hash, gram false; the value of a
    gram beyond it under its key, gram true. Contexts grow by a word at the front, up to ``depth`` words: one is tried if it occurs
    LEAST_CONTEXT times, the words before its last were tried, and its own suffix is a state. Each
    length takes a pass over the texts; counts, states and probabilities are Spark tables.
    """
    sc = train.sparkSession.sparkContext
    vocabulary = stash(word_counts(train, text_col), "lm-words")
    known_words = keyed(vocabulary)
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = max(2, math.ceil(tokens * SHARE))
    top = vocabulary.where(F.col("n") >= floor).select("h", "n").toArrow()
    tree = SuffixTree(tokens, distinct, top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy())
    shared = sc.broadcast(tree)
    begin = F.lit(int(word_keys(np.array([BEGIN]))[0]))
    # The begin of a text is as frequent as its end.
    contexts = known_words.select(F.when(F.col("h") == F.lit(int(END)), begin).otherwise(F.col("key")).alias("context"), F.col("n").alias("total")).where(F.col("total") >= LEAST_CONTEXT[1])
    tried = known_words.where("n >= 2").select("key")
    parents = useful = None
    # What is not kept goes to the other words alone, else ever longer contexts would drift from their own counts.
    beyond = F.greatest(1 - F.col("other"), F.lit(1e-12))
    # Where keys of different grams collide, more may be kept than the context has.
    spread = (F.greatest(F.col("total") - F.col("kept"), F.lit(0)) + SMOOTHING * beyond) / ((F.col("total") + SMOOTHING) * beyond)
    tables: list[DataFrame] = []
    for length in range(2, depth + 2):
        if tried.isEmpty():
            break
        known = sc.broadcast(key_filter(tried))
        counted = stash(count_grams(train, text_col, shared, known, useful, length), "lm-counts")
        known.destroy()
        if useful:
            useful.destroy()
        rows = counted
        # Different words or grams of one key (there are some among 10^7) cannot be told apart when texts are scored: they are one context, one parent.
        if parents is not None:
            rows = counted.drop("expected").join(parents.groupBy("parent").agg(F.min("expected").alias("expected")), "parent")
        rows = rows.join(contexts.groupBy("context").agg(F.sum("total").alias("total")), "context").select("key", "context", "n", "total", "expected")
        if length == 2:
            mean = F.col("total") * F.col("expected")
            rows = rows.where((F.col("n") > 2) | (F.col("n") > mean) & (F.col("n") * F.ln(F.col("n") / mean) - F.col("n") + mean >= NEXT_GAIN))
        p = F.least((F.col("n") + SMOOTHING * F.col("expected")) / (F.col("total") + SMOOTHING), F.lit(1.0))
        grams = rows.join(retained(rows), "context").withColumns({"p": p, "weight": F.log10(spread)})
        bonus = F.log10(F.col("p") / F.col("expected")) - F.col("weight")
        grams = stash(grams.select("key", "n", F.when(F.col("n") >= min(LEAST_NEXT[2:]), F.col("p").cast("float")).alias("p"), bonus.cast("float").alias("bonus"), "context", "total", F.col("weight").cast("float").alias("weight")), "lm-grams")
        states = grams.groupBy("context").agg(F.first("total").alias("total"), F.first("weight").alias("weight"))
        tables += [grams.select("key", "n", F.col("bonus").cast("double").alias("value")), states.select(F.col("context").alias("key"), F.col("total").alias("n"), F.col("weight").cast("double").alias("value"))]
        if length <= depth:
            longer_ones = counted.where(F.col("n") >= least_of(LEAST_CONTEXT, length)).join(states.select(F.col("context").alias("parent")), "parent")
            longer_ones = stash(longer_ones.select(F.col("key").alias("context"), F.col("n").alias("total")), "lm-contexts")
            if length > 2:
                discard(contexts)
            contexts, tried = longer_ones, longer_ones.select("context")
            parents = grams.where(F.col("p").isNotNull()).select(F.col("key").alias("parent"), F.col("p").alias("expected"))
            useful = sc.broadcast(key_filter(parents.select("parent").unionByName(tried.select(F.col("context").alias("parent")))))
        discard(counted)
        del counted, rows
        tidy(train.sparkSession)
    shared.destroy()
    rest = vocabulary.where(F.col("n") < floor).select(F.col("h").alias("key"), F.col("n").cast("double").alias("value"), F.lit(False).alias("gram"))
    if tables:
        values = functools.reduce(DataFrame.unionByName, tables)
        top = values.where(F.col("n") >= floor).select("key", "value").toArrow()
        keys, _, tree.values = totals(top.column("key").to_numpy().view(np.uint64), top.column("value").to_numpy())
        tree.grams, tree.longest = Table(keys), len(tables) // 2 + 1
        tree.some = key_filter(values.select("key").unionByName(rest.select("key")))
        rest = rest.unionByName(values.where(F.col("n") < floor).select("key", "value", F.lit(True).alias("gram")))
    elif tokens:
        tree.some = key_filter(rest.select("key"))
    return tree, rest


def part_sums(rows: Iterator[tuple[int | None, bytes | None, bytes | None]]) -> tuple[np.ndarray, ...] | None:
    """Ids of the texts of a part that have words or grams in its model, their known words, and their sums over words and over grams.

    ``rows``: (first id, postings, None) and (None, None, model), the model's first. Some MET postings meet the model at a time; a text's postings of a part stand in one value.
    """
    models, found, sent, held, met = [], [], [], 0, None

    def sums() -> tuple[np.ndarray, ...]:
        table, value, gram = met
        row, wanted, times = (np.concatenate(x) for x in zip(*sent, strict=True))
        at = table.find(wanted)
        good = at >= 0
        row, at, times = row[good], at[good], times[good].astype(np.int64)
        word = ~gram[at]
        ids, back = np.unique(row, return_inverse=True)
        by = lambda x: np.bincount(back, x, len(ids))
        known = by(np.where(word, times, 0)).astype(np.uint64)
        words = by(np.where(word, np.log10(np.where(word, value[at], 0) + 1.0) * times, 0))
        return ids, known, words, by(np.where(word, 0, value[at] * times)).astype(np.float32)

    for low, blob, model in rows:
        if model is not None:
            models.append(unpack(model, (8, 8, 1)))
            continue
        if met is None:
            if not models:
                return None
            key, value, gram = (np.concatenate(x) for x in zip(*models, strict=True))
            models.clear()
            key, first, value = totals(key, value.view(np.float64))
            met = Table(key), value, gram[first] > 0
        step, wanted, times = unpack(blob, (4, 8, 4))
        sent.append((np.cumsum(step.astype(np.int64)) + low, wanted, times))
        held += len(wanted)
        if held >= MET:
            found.append(sums())
            sent, held = [], 0
    if sent:
        found.append(sums())
    if not sum(len(x[0]) for x in found):
        return None
    ids, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ids)
    return ids[order], *(x[order] for x in rest)


def score_texts(docs: DataFrame, tree: SuffixTree, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """log10 probability of every whole text: id, ``keep``, n_tokens, n_known, base_score, score.

    The tree is broadcast. Words and grams beyond it (each rarer than a share of all tokens) go to
    a join with the rest of the model: tasks send them packed, part by part, each part meets its
    rows of the model, and a text's sums come back. Null texts count as empty (one token, the end);
    rows stay as they are, repeated or without id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    parts = parts_of(tree.tokens, docs)
    slim = docs.select(F.col(id_col).alias(id_col), *keep, F.col(text_col).cast("string").cast("binary").alias("_text"))
    own = [f for f in slim.schema if f.name != "_text"]
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in own]
    sums = "n_tokens long, n_known long, base_score double, score double"
    columns_met = [f.name for f in own] + ["n_tokens", "n_known", "base_score", "score", "_row", "_group", "_sums"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        first = TaskContext.get().partitionId() << 32
        sent: list[tuple[np.ndarray, ...]] = []
        n = held = 0

        def flush() -> pa.RecordBatch:
            row, key, times = (np.concatenate(x) for x in zip(*sent, strict=True))
            low = int(row.min())
            where, blobs = bucketed((mixed(key) % _U(parts)).astype(np.int64), parts, [row - low, key, times], lambda r, k, n: pack([(np.diff(r, prepend=0), 4), (k, 8), (n, 4)]))
            return batch_of(None, [first + low] * len(blobs), None, where, blobs)

        def batch_of(own: list | None, row: list, made: tuple | None, bucket: list, blob: list) -> pa.RecordBatch:
            size = len(row)
            arrays = own or [pa.nulls(size, f.type) for f in arrow_own]
            made = [pa.array(x) for x in made] if made else [pa.nulls(size, k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*arrays, *made, pa.array(row, pa.int64()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], names=columns_out)

        arrow_own = None
        columns_out = [f.name for f in own] + ["n_tokens", "n_known", "base_score", "score", "_row", "_bucket", "_blob"]
        for batch in batches:
            arrow_own = list(batch.schema)[:-1]
            made: list[list] = [[], [], [], []]
            start = n
            for group in text_groups(batch.column(batch.num_columns - 1).to_pylist()):
                sizes, seen, base, whole, (text, key) = t.score(group)
                for column, values in zip(made, (sizes, seen, base, whole), strict=True):
                    column.append(values)
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
                sent.append((text[new] + n, key[new], np.diff(np.append(new, len(key)))))
                held += len(new)
                n += len(group)
                if held >= POSTINGS:
                    yield flush()
                    sent, held = [], 0
            if n > start:
                rows = list(range(first + start, first + n))
                yield batch_of(list(batch.columns[:-1]), rows, tuple(np.concatenate(x) for x in made), [-1 - i % parts for i in range(start, n)], [None] * len(rows))
        if held:
            yield flush()
        sent.clear()
        let_go()

    def model_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            gram = batch.column(2).to_numpy(zero_copy_only=False)
            key = np.where(gram, key | GRAM, key)
            where, blobs = bucketed((mixed(key) % _U(parts)).astype(np.int64), parts, [key, value.view(np.uint64), gram], lambda k, v, g: pack([(k, 8), (v, 8), (g, 1)]))
            yield pa.RecordBatch.from_pydict({"_bucket": pa.array(where, pa.int64()), "_model": pa.array(blobs, pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(own)
        blank: list[pa.DataType] = []

        def parted() -> Iterator[tuple | pa.RecordBatch]:
            """Rows of texts as they come, and (bucket, place, postings, model) of the others."""
            for batch in batches:
                blank[:] = [f.type for f in list(batch.schema)[:width]]
                text = pa.compute.and_(batch.column(width + 6).is_null(), batch.column(width + 7).is_null())
                kept = batch.filter(text)
                if kept.num_rows:
                    row = kept.column(width + 4)
                    group = pa.array(row.to_numpy() >> GROUP_BITS)
                    yield pa.RecordBatch.from_arrays([*kept.columns[: width + 5], group, pa.nulls(kept.num_rows, pa.binary())], names=columns_met)
                # Large values are taken one by one, so that a batch is not held twice.
                rest = [batch.column(width + k) for k in (5, 4, 6, 7)]
                for i in np.flatnonzero(~text.to_numpy(zero_copy_only=False)).tolist():
                    yield tuple(c[i].as_py() for c in rest)

        for bucket, rows in groupby(parted(), key=lambda r: r[0] if isinstance(r, tuple) else None):
            if bucket is None:
                yield from rows
                continue
            found = part_sums((low, blob, model) for _, low, blob, model in rows)
            if found is None:
                continue
            ids, known, words, grams = found
            where, blobs = [], []
            cut = np.flatnonzero(np.diff(ids >> GROUP_BITS, prepend=-1, append=-1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                some = known[a:b] > 0  # most texts have no rare word in a part
                place = (ids[a:b] & ((1 << GROUP_BITS) - 1)).astype(np.uint64)
                where.append(int(ids[a] >> GROUP_BITS))
                blobs.append(pack([(place, 2), (grams[a:b].view(np.uint32), 4), (known[a:b], 4), (words[a:b][some].view(np.uint64), 8)]))
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in blank), *(pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())), pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], names=columns_met)
            del found, ids, known, words, grams
            let_go()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the sums of all parts to the texts of a group."""
        width = len(own)

        def groups() -> Iterator[list[pa.RecordBatch]]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                group = batch.column(width + 5).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if a < b:
                        if held and group[a] != last:
                            yield held
                            held = []
                        last = group[a]
                        held.append(batch.slice(a, b - a))
            if held:
                yield held

        for held in groups():
            table = pa.Table.from_batches(held).combine_chunks()
            sums = table.column(width + 6)
            texts = table.filter(sums.is_null())
            known, words, grams = (np.zeros(1 << GROUP_BITS) for _ in range(3))
            for blob in sums.drop_null().to_pylist():
                place, g, k, w = unpack(blob, (2, 4, 4, 8))
                place = place.astype(np.int64)
                grams[place] += g.astype(np.uint32).view(np.float32)
                known[place] += k.astype(np.float64)
                words[place[k > 0]] += w.view(np.float64)
            if not texts.num_rows:
                continue
            at = texts.column(width + 4).to_numpy() & ((1 << GROUP_BITS) - 1)
            more = [known[at].astype(np.int64), words[at], words[at] + grams[at]]
            found = [texts.column(width + 1 + i).to_numpy() + x for i, x in enumerate(more)]
            out = pa.Table.from_arrays([*texts.columns[: width + 1], *map(pa.array, found)], names=columns_met[: width + 4])
            yield from out.combine_chunks().to_batches()

    made = slim.mapInArrow(score, ", ".join([*names, sums, "_row long, _bucket long, _blob binary"]))
    rest = model.mapInArrow(model_parts, "_bucket long, _model binary")
    met = dealt(made.unionByName(rest, allowMissingColumns=True), "_bucket", F.col("_model").isNull()).mapInArrow(join, ", ".join([*names, sums, "_row long, _group long, _sums binary"]))
    total = dealt(met, "_group").mapInArrow(finish, ", ".join([*names, sums]))
    return total.select(id_col, *keep, "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all ``docs`` under the tree learnt from those whose CRC-32 of the id is not 2 modulo 7; a null id is held out."""
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True)))
    tree, model = fit_suffix_tree(docs.where(~F.col("held_out")), text_col)
    return score_texts(docs, tree, model, id_col, text_col, ("held_out",))

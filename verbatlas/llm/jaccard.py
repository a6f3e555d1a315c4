"""N-gram Jaccard join by block-skipping index lists and answers derived from a similar set's."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.batches import map_texts, mixed, planes, text_groups, unplaned, word_hashes
from verbatlas.operators.components import connected_components
from verbatlas.sources.shared import stash, tidy

#: Index entries that a task holds before it sends them on, and sets in a block of a family.
FLUSH, FAMILY_BLOCK = 500_000, 512
#: Shingles of the distinct sets for each bucket of the index: a task holds one bucket at a time.
BUCKET_SHINGLES = 2_000_000
#: Columns of a dense block of differences at a time.
DENSE = 1 << 14
#: Least bits of a set's parity sketch (large sets have at least twice as many as shingles), and sets in a block when least sketches are compared.
SKETCH, SKETCH_BLOCK = 1024, 4096
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct ``width``-word shingles; of fewer words, the whole sequence as one; empty without words."""
    for group in text_groups(texts):
        h, counts = word_hashes([t or b"" for t in group])
        stops = np.cumsum(counts)
        codes: dict[int, np.ndarray] = {}
        for n in range(1, width + 1):
            if n == width or (counts == n).any():
                code = np.full(max(len(h) - n + 1, 0), n, np.uint64)
                for i in range(n):
                    code = mixed(code * _BASE + h[i : len(code) + i])
                codes[n] = code
        for stop, count in zip(stops.tolist(), counts.tolist(), strict=True):
            n = min(width, count)
            own = np.sort(codes[n][stop - count : stop - n + 1]) if count else h[:0]
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return next(shingle_sets([text], width))


def set_key(found: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def parity_sketch(found: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit: two sets differ in at least as many shingles as their sketches in bits.

    The number of bits is a power of two; halves laid over one another give the next smaller sketch.
    """
    bits = SKETCH
    while bits < 2 * len(found):
        bits *= 2
    return np.packbits((np.bincount(((found >> _U(7)) % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded_signs(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of one length as rows of +1 and -1, folded to ``bits``."""
    rows = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8)).reshape(len(sketches), -1, bits)
    return (np.bitwise_xor.reduce(rows, axis=1)).astype(np.float32) * 2 - 1


def spanning(good: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row) that span the components of a symmetric boolean matrix."""
    edges, left = [], np.ones(len(good), bool)
    for start in range(len(good)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(good[at] & left)
            left[near] = False
            todo += near.tolist()
            edges += [(at, x) for x in near.tolist()]
    return edges


def spanning_between(good: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that span the components of a bipartite boolean matrix."""
    edges, rows_left, columns_left = [], np.ones(good.shape[0], bool), np.ones(good.shape[1], bool)
    for start in np.flatnonzero(good.any(axis=1)).tolist():
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [start]
        while todo:
            row = todo.pop()
            for column in np.flatnonzero(good[row] & columns_left).tolist():
                columns_left[column] = False
                edges.append((row, column))
                near = np.flatnonzero(good[:, column] & rows_left)
                rows_left[near] = False
                edges += [(x, column) for x in near.tolist()]
                todo += near.tolist()
    return edges


class Bounds:
    """What a Jaccard threshold num / den allows.

    Sizes fall into classes so that two linked sets lie in one class or in neighbours. They differ
    in at most ``differ(class of the larger)`` shingles, so if the hash range is cut into more
    parts than that, they hold the same shingles in some part.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 28:
            self.starts.append(self.starts[-1] * den // num + 1)
        self.known: dict[int, tuple[int, int]] = {}

    def linked(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def parts(self, c: int) -> tuple[int, int]:
        """(differences allowed, spare parts) of pairs whose larger set is in class ``c``.

        With s spare parts a set needs s empty parts before agreeing on empty parts alone could
        matter; s is the least that makes that unlikely (or the best there is).
        """
        if c not in self.known:
            k = 2 * (self.starts[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            least = max(1, self.starts[c] * self.num // self.den)

            def risk(s: int) -> float:
                mean = (k + s) * math.exp(-least / (k + s))
                terms = [math.exp(-mean)]
                for i in range(1, s):
                    terms.append(terms[-1] * mean / i)
                return 1 - sum(terms)

            best = (2.0, 1)
            for s in range(1, 4 + k // 8):
                best = min(best, (risk(s), s))
                if best[0] < 1e-5:
                    break
            self.known[c] = (k, best[1])
        return self.known[c]

    def prefix(self, n: int) -> int:
        """How many first shingles in hash order two linked sets cannot both do without."""
        return n - -(-self.num * n // self.den) + 1


def index_entries(found: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List key, position of the run in the sorted set, and run length, for each list that a set belongs to.

    A list is keyed by the content of one part of the hash range, that is by a run of consecutive
    shingles in hash order. Sets with too many empty parts also join lists of single prefix shingles.
    """
    keys, places, lengths = [], [], []
    own = bounds.size_class(len(found))
    scrambled = mixed(found)
    for c in (own, own + 1):
        k, spare = bounds.parts(c)
        if k == 0:
            continue  # linked sets of this class are equal
        parts = k + spare
        part = ((found >> _U(32)) * _U(parts)) >> _U(32)
        edge = np.empty(len(part), bool)
        edge[0] = True
        np.not_equal(part[1:], part[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        tag = _U(c * 2 * 0xD6E8FEB86659FD93 % (1 << 64))
        keys.append(mixed(np.add.reduceat(scrambled, at) + tag + part[at] * _U(0xA0761D6478BD642F)))
        places.append(at)
        run = np.empty_like(at)
        run[:-1], run[-1] = at[1:] - at[:-1], len(found) - at[-1]
        lengths.append(run)
        if parts - len(at) >= spare:
            first = np.arange(bounds.prefix(len(found)))
            keys.append(mixed(scrambled[first] + tag + _U(0xE7037ED1A0B428DB)))
            places.append(first)
            lengths.append(np.ones(len(first), np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(lengths)


ENTRY = np.dtype([("list", "<u8"), ("set", "<i8"), ("size", "<u4"), ("at", "<u4"), ("run", "<u4")])


#: Bytes of a list's key that travel: lists that agree in them by chance only add candidates.
KEY_BYTES = 5


def pack(entries: np.ndarray) -> bytes:
    """Entries set by set: each set and its size once, then for each entry its list key, the step to its set and position, and its run."""
    entries = entries[np.lexsort((entries["at"], entries["set"]))]
    sets, first, owner = np.unique(entries["set"], return_index=True, return_inverse=True)
    steps = np.diff(owner, prepend=0)
    at = entries["at"].astype(np.int64)
    jumps = np.where(np.diff(owner, prepend=-1) > 0, at, np.diff(at, prepend=0))
    head = np.array([len(entries), len(sets)], "<u8").tobytes()
    return head + planes(sets.view(np.uint64), 8) + planes(entries["size"][first], 4) + planes(entries["list"], KEY_BYTES) + planes(steps, 4) + planes(jumps, 4) + planes(entries["run"], 4)


def unpack(blob: bytes) -> np.ndarray:
    n, m = np.frombuffer(blob, "<u8", 2).tolist()
    out, p = np.empty(n, ENTRY), 16
    columns = []
    for count, width in ((m, 8), (m, 4), (n, KEY_BYTES), (n, 4), (n, 4), (n, 4)):
        columns.append(unplaned(blob, p, count, width))
        p += count * width
    sets, sizes, lists, steps, jumps, runs = columns
    owner = np.cumsum(steps.astype(np.int64))
    new = np.diff(owner, prepend=-1) > 0
    total = np.cumsum(jumps.astype(np.int64))
    starts = np.flatnonzero(new)
    base = np.repeat(total[starts] - jumps[starts].astype(np.int64), np.diff(np.append(starts, n)))
    out["list"], out["set"], out["size"], out["at"], out["run"] = lists, sets.view(np.int64)[owner], sizes[owner], total - base, runs
    return out


def merged_blocks(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each block (list, size, position), and an edge from its set to each other set of the block."""
    entries = entries[np.lexsort((entries["set"], entries["at"], entries["size"], entries["list"]))]
    new = np.ones(len(entries), bool)
    same = np.ones(max(len(entries) - 1, 0), bool)
    for f in ("list", "size", "at"):
        same &= entries[f][1:] == entries[f][:-1]
    new[1:] = ~same
    leader = np.maximum.accumulate(np.where(new, np.arange(len(entries)), 0))
    other = ~new & (entries["set"] != entries["set"][leader])
    return entries[new], np.stack([entries["set"][other], entries["set"][leader[other]]], 1)


def block_edges(blocks: np.ndarray, bounds: Bounds) -> list[tuple[int, int]]:
    """Edges that join the blocks of one list which sizes and positions let be linked; the rest is skipped unread.

    Equal runs at positions a and b leave room for min(a, b) common shingles before and as many
    after as the shorter rest; if that is not enough for the sizes, no pair of the two blocks is linked.
    """
    n, at, run = (blocks[f].astype(np.int64) for f in ("size", "at", "run"))
    rest = n - at - run
    root = list(range(len(n)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for j in range(1, len(n)):
        low = int(np.searchsorted(n[:j], -(-bounds.num * n[j] // bounds.den))) if j > 8 else 0
        most = np.minimum(at[low:j], at[j]) + run[j] + np.minimum(rest[low:j], rest[j])
        for i in (np.flatnonzero(bounds.linked(most, n[low:j], n[j])) + low).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                edges.append((int(blocks["set"][i]), int(blocks["set"][j])))
    return edges


def candidate_edges(docs: DataFrame, text_col: str, width: int, bounds: Bounds, shingles: int) -> DataFrame:
    """a, b: edges that connect every two different sets which may be linked.

    Tasks index their own texts, merge the blocks they share (so that a hot list shrinks to its
    distinct sizes and positions before the shuffle) and send entries in one binary value for each
    bucket. There are as many buckets as the shuffle has partitions, more where the table has many ``shingles``, so that a bucket is of bounded size.
    """
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, seen = 0, set()

        def flush() -> pa.RecordBatch:
            entries, edges = merged_blocks(np.concatenate(held) if held else np.zeros(0, ENTRY))
            bucket = ((entries["list"] >> _U(40)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            blobs = [pack(entries[order[cut[b] : cut[b + 1]]]) for b in full]
            edges = np.unique(edges, axis=0)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([*full.tolist(), *range(min(1, len(edges)))], pa.int32()), "entries": pa.array([*blobs, *[b""] * min(1, len(edges))], pa.binary()), "edges": pa.array([*[b""] * len(blobs), *[edges.tobytes()] * min(1, len(edges))], pa.binary())})

        for batch in batches:
            for found in shingle_sets(batch.column(0).to_pylist(), width):
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                keys, places, lengths = index_entries(found, bounds)
                own = np.empty(len(keys), ENTRY)
                own["list"], own["set"], own["size"], own["at"], own["run"] = keys, key, len(found), places, lengths
                held.append(own)
                n += len(own)
                if n >= FLUSH:
                    yield flush()
                    held, n, seen = [], 0, set()
        if held:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            held: list[np.ndarray] = []
            edges: list[np.ndarray] = []
            for _, blob, more in group:
                if blob:
                    held.append(unpack(blob))
                if more:
                    edges.append(np.frombuffer(more, np.int64).reshape(-1, 2))
            if held:
                blocks, own = merged_blocks(np.concatenate(held))
                del held
                new = np.flatnonzero(np.concatenate([[True], blocks["list"][1:] != blocks["list"][:-1], [True]]))
                found = []
                for i in np.flatnonzero(np.diff(new) > 1):
                    found += block_edges(blocks[new[i] : new[i + 1]], bounds)
                edges += [own, np.array(found, np.int64).reshape(-1, 2)]
            found = np.unique(np.concatenate(edges), axis=0)
            yield pa.RecordBatch.from_pydict({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    sent = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(index, "bucket int, entries binary, edges binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "a long, b long").where("a <> b").distinct()


def shared_differences(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every left and right set of differences; only elements that occur twice are looked at."""
    every, at, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    twice = counts[at] > 1
    at, row = (np.cumsum(counts > 1) - 1)[at[twice]], row[twice]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, DENSE):
        a, b = np.searchsorted(at, (start, start + DENSE))
        dense = np.zeros((len(left) + len(right), DENSE), np.float32)
        dense[row[a:b], at[a:b] - start] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


def family_links(left: list[tuple[int, int, int, np.ndarray]], right: list[tuple[int, int, int, np.ndarray]], bounds: Bounds, same: bool) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Edges spanning the links between two blocks (set, copies, size, differences) of a family, and linked copies by set.

    One set's answers are computed, as differences from it; every other set's answers follow from
    its own few differences: |x ^ y| = |dx| + |dy| - 2 |dx & dy|, which gives their overlap.
    """
    dl = [d for *_, d in left]
    dr = dl if same else [d for *_, d in right]
    sizes = [np.array([n for _, _, n, _ in x], np.int64) for x in (left, right)]
    apart = [np.array([len(d) for d in x], np.int64) for x in (dl, dr)]
    xor = apart[0][:, None] + apart[1][None] - 2 * shared_differences(dl, dr)
    inter = (sizes[0][:, None] + sizes[1][None] - xor) // 2
    good = bounds.linked(inter, sizes[0][:, None], sizes[1][None])
    if same:
        np.fill_diagonal(good, False)
    copies = [np.array([c for _, c, *_ in x], np.int64) for x in (left, right)]
    links = {left[i][0]: int(n) for i, n in enumerate(good @ copies[1]) if n}
    if not same:
        links |= {right[j][0]: int(n) for j, n in enumerate(copies[0] @ good) if n}
    edges = [(left[i][0], left[j][0]) for i, j in spanning(good)] if same else [(left[i][0], right[j][0]) for i, j in spanning_between(good)]
    return edges, links


def refined_families(families: DataFrame, sketched: DataFrame, bounds: Bounds) -> DataFrame:
    """``families`` (node, component), where every family beyond one block is parted by its sketches.

    Sets that share a passage by chance chain into wide families. Blocks of SKETCH_BLOCK sketches, by
    set size, meet the blocks whose sizes allow links; a pair whose sketches differ in more bits than
    linked sets of those sizes may differ in shingles is not linked, so no link is lost. Only an
    edge list that spans what is left comes out of a pair of blocks.
    """
    wide = families.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_BLOCK).select("component")
    rows = families.join(wide, "component", "left_semi").join(sketched, families["node"] == sketched["set"]).select("component", "set", "n_shingles", "sketch")
    rows = stash(rows, "jaccard-sketches")
    # Blocks hold sketches of one length; longer ones stand fewer to a block, so that a block's bits are bounded.
    by_size = rows.groupBy("component", "n_shingles").agg(F.count("*").alias("_n"), F.max(F.round(F.log2(F.octet_length("sketch") * 8 / SKETCH)).cast("int")).alias("_level"))
    upto = Window.partitionBy("component", "_level").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_size.withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    at = F.floor((F.col("_start") + F.pmod(F.xxhash64("set"), F.col("_n"))) / F.greatest(F.lit(2), F.floor(F.lit(SKETCH_BLOCK) / F.pow(F.lit(2.0), "_level"))))
    rows = rows.join(placed, ["component", "n_shingles"]).withColumn("block", F.col("_level") * (1 << 40) + at.cast("long")).drop("_start", "_n", "_level")
    spans = rows.groupBy("component", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    other = spans.select("component", F.col("block").alias("right"), F.col("lo").alias("lo2"))
    pairs = spans.withColumnRenamed("block", "left").join(other, "component").where((F.col("left") <= F.col("right")) & (F.col("lo2") * bounds.num <= F.col("hi") * bounds.den)).select("component", "left", "right")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right"))))
    met = rows.join(sides, ["component", "block"]).select("component", "left", "right", "block", "set", "n_shingles", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, left, right), group in groupby(found, key=lambda r: r[:3]):
            sides: dict[int, list] = {left: [], right: []}
            for r in group:
                sides[r[3]].append(r[4:])
            if not sides[left] or not sides[right]:
                continue
            names, sizes, signs = [], [], []
            bits = 8 * min(len(x[0][2]) for x in (sides[left], sides[right]))
            for x in (sides[left], sides[right]):
                names.append([r[0] for r in x])
                sizes.append(np.array([r[1] for r in x], np.int64))
                signs.append(folded_signs([r[2] for r in x], bits))
            good = np.empty((len(sizes[0]), len(sizes[1])), bool)
            for i in range(0, len(good), 256):  # a strip at a time keeps numbers few
                n = sizes[0][i : i + 256, None]
                apart = (bits - signs[0][i : i + 256] @ signs[1].T) / 2
                near = np.minimum(n, sizes[1]) * bounds.den >= np.maximum(n, sizes[1]) * bounds.num
                good[i : i + 256] = near & (apart * (bounds.den + bounds.num) <= (n + sizes[1]) * (bounds.den - bounds.num) + 0.5)
            if left == right:
                np.fill_diagonal(good, False)
            edges = spanning(good) if left == right else spanning_between(good)
            if edges:
                yield pa.RecordBatch.from_pydict({"a": pa.array([names[0][i] for i, _ in edges], pa.int64()), "b": pa.array([names[1][j] for _, j in edges], pa.int64())})

    edges = met.repartition("component", "left", "right").sortWithinPartitions("component", "left", "right").mapInArrow(compare, "a long, b long")
    return families.join(wide, "component", "left_anti").select("node", "component").unionByName(connected_components(edges))


def jaccard_groups(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that chains of links join; two link if the Jaccard similarity of their shingle sets is at least num / den.

    Exact: no link is missed or guessed. Equal sets are one set throughout. An index of lists, whose
    entries stand in blocks of equal size and position, gives edges between sets that may be linked
    (blocks that sizes or positions rule out are skipped); their components are families, and wide
    families are parted by sketches that bound differences. Families are compared block against block, each set by its differences from one of them, and of
    a family of several blocks only those differences travel. Work within a
    family of m different sets grows with m squared over many tasks; nothing is emitted for pairs.

    Returns id, n_shingles, n_links (other documents linked directly), component_id (smallest id of
    the group). Documents without words (null, empty) are linked with nothing and stand alone. Rows
    without id are linked with nothing: n_links 0, component_id null. Rows that repeat an id count
    as documents of their own and share the id. Extra columns are ignored.
    """
    bounds = Bounds(num, den)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))

    def sizes(texts: list[bytes | None]) -> list[list]:
        found = list(shingle_sets(texts, width))
        return [[len(s) for s in found], [set_key(s) for s in found], [parity_sketch(s) for s in found]]

    keys = stash(map_texts(docs, "id", "text", sizes, "n_shingles long, set long, sketch binary", ("version",)), "jaccard-keys")
    live = keys.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    shingles = live.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    chained = stash(connected_components(candidate_edges(docs.where(F.col("id").isNotNull()), "text", width, bounds, shingles)), "jaccard-chains")
    sketched = live.groupBy("set").agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    families = stash(refined_families(chained, sketched, bounds), "jaccard-families")
    tidy(docs.sparkSession)
    blocks = families.groupBy("component").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    # A set is read again from one row alone: an id may repeat, an id and the hash of its text tell its rows apart.
    one = F.min(F.struct("id", "version"))
    distinct_sets = stash(live.groupBy("set").agg(one.alias("one"), F.count("*").alias("copies")).select("set", F.col("one.id").alias("rep"), F.col("one.version").alias("version"), "copies"), "jaccard-sets")
    members = families.withColumnRenamed("node", "set").join(blocks, "component").join(distinct_sets, "set")
    members = members.select("set", "component", "copies", "blocks", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("id"), "version")
    texts = docs.join(members, ["id", "version"])

    def sets_of(raw: list[bytes | None]) -> list[list]:
        found = list(shingle_sets(raw, width))
        return [[set_key(s) for s in found], [s.tobytes() for s in found]]

    made = map_texts(texts, "id", "text", sets_of, "found long, shingles binary", ("set", "component", "copies", "blocks", "block")).where("found = set").dropDuplicates(["set"])
    made = stash(made, "jaccard-members")
    pivots = made.where("blocks > 1").groupBy("component").agg(F.min_by("shingles", "set").alias("pivot"))

    def lessen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of wide families as their differences from the family's pivot."""
        for batch in batches:
            own = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64), assume_unique=True).tobytes() for x, p in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own, pa.binary())], names=["component", "set", "copies", "block", "size", "shingles"])

    sized = made.select("component", "set", "copies", "block", (F.octet_length("shingles") / 8).cast("int").alias("size"), "shingles", "blocks")
    wide = sized.where("blocks > 1").drop("blocks").join(pivots, "component").mapInArrow(lessen, "component long, set long, copies long, block int, size int, shingles binary")
    blocks_of = blocks.where("blocks > 1")
    wide = wide.join(blocks_of, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    narrow = sized.where("blocks = 1").withColumn("other", F.lit(0))
    pairs = narrow.unionByName(wide.select(narrow.columns))
    pairs = pairs.select("component", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "set", "copies", "size", "shingles", (F.col("blocks") > 1).alias("lessened"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, left, right), group in groupby(rows, key=lambda r: r[:3]):
            sides: dict[int, list] = {left: [], right: []}
            for r in group:
                sides[r[3]].append((r[4], r[5], r[6], np.frombuffer(r[7], np.uint64)))
                lessened = r[8]
            if not sides[left] or not sides[right]:
                continue
            if not lessened:
                pivot = sides[left][0][3]
                sides[left] = [(*x[:3], np.setxor1d(x[3], pivot, assume_unique=True)) for x in sides[left]]
            edges, links = family_links(sides[left], sides[right], bounds, left == right)
            if edges:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in edges] + list(links), "b": [b for _, b in edges] + [None] * len(links), "links": [0] * len(edges) + list(links.values())}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    answers = stash(pairs.repartition("component", "left", "right").sortWithinPartitions("component", "left", "right").mapInArrow(compare, "a long, b long, links long"), "jaccard-answers")
    tidy(docs.sparkSession)
    components = connected_components(answers.where(F.col("b").isNotNull()).select("a", "b"))
    links = answers.where(F.col("b").isNull()).groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("_more"))
    labels = distinct_sets.join(components.withColumnRenamed("node", "set"), "set", "left").select("set", "rep", "copies", F.coalesce("component", "set").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = labels.join(smallest, "label").join(links, "set", "left").select("set", "component_id", (F.col("copies") - 1 + F.coalesce("_more", F.lit(0))).alias("n_links"))
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    out = keys.drop("sketch").join(known, "set", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

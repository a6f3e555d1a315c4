import random

import numpy as np
import pytest

from verbatlas.llm import jaccard
from verbatlas.llm.jaccard import Bounds, jaccard_groups, shingle_set


def brute(rows, width, num, den):
    """component_id and n_links by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in (text or "")).split()]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d is None, d, len(s), n, low.get(find(i)) if d is not None else None) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(0, 5)):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], rng.choice(vocab)]])
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12, 20, 60, 200]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("width", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (3, 60, 100, 3), (1, 80, 100, 4)])
def test_equals_all_pairs(spark, width, num, den, seed):
    rows = corpus(random.Random(seed), 250) + [(1000, None), (1001, ""), (1002, " \n"), (None, "w1 w2 w3 w4"), (1003, "W1 w2\tw3 w4"), (1004, "w1 w2 w3 w4")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_links string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard_groups(docs, width, num, den).collect()), key=str)
    assert got == brute(rows, width, num, den)


@pytest.mark.parametrize(("block", "sketch_block"), [(3, 7), (10, 4096)])
def test_small_blocks_give_the_same(spark, monkeypatch, block, sketch_block):
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", block)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", sketch_block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = corpus(rng, 60)
    for i in range(100, 180):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    long = [f"l{rng.randrange(5000)}" for _ in range(900)]
    for i in range(200, 215):
        words = list(long)
        for _ in range(rng.randrange(0, 60)):
            words[rng.randrange(900)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((False, r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard_groups(docs, 3, 80, 100).collect()), key=str)
    assert got == brute(rows, 3, 80, 100)


def test_sketches_never_claim_more_than_there_is():
    rng = random.Random(1)
    for _ in range(200):
        a = np.unique(np.array([rng.randrange(1 << 60) for _ in range(rng.randrange(1, 3000))], np.uint64))
        b = np.unique(np.concatenate([a[rng.randrange(len(a)) :], np.array([rng.randrange(1 << 60) for _ in range(rng.randrange(0, 50))], np.uint64)]))
        x, y = jaccard.parity_sketch(a), jaccard.parity_sketch(b)
        bits = 8 * min(len(x), len(y))
        apart = (bits - float(jaccard.folded_signs([x], bits)[0] @ jaccard.folded_signs([y], bits)[0])) / 2
        assert apart <= len(np.setxor1d(a, b))


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        e = np.empty(n, jaccard.ENTRY)
        e["list"], e["set"] = rng.integers(0, 1 << 63, n, np.uint64), rng.choice(rng.integers(-(1 << 63), 1 << 63, 7), n)
        e["size"], e["at"], e["run"] = e["set"] % 1000 + 1000, rng.integers(0, 900, n), rng.integers(1, 9, n)
        back = jaccard.unpack(jaccard.pack(e))
        low = lambda x: sorted((int(r["list"]) % (1 << 40), *(int(r[f]) for f in ("set", "size", "at", "run"))) for r in x)
        assert low(back) == low(e)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups(docs).count() == 0


def test_classes_hold_linked_sizes():
    for num, den in ((9, 10), (8, 10), (1, 2)):
        b = Bounds(num, den)
        for x in range(1, 400):
            for y in range(x, x * den // num + 1):
                c = b.size_class(y)
                assert c - b.size_class(x) in (0, 1)
                assert (x + y) * (den - num) // (den + num) <= b.parts(c)[0]


def test_shingles_of_short_texts():
    assert len(shingle_set(b"a b", 3)) == 1
    assert len(shingle_set(None, 3)) == 0
    assert len(shingle_set(b"a b a b a b a", 3)) == 2


def test_rows_of_one_id_are_read_once(spark, monkeypatch):
    """Near copies under one id: each text meets its own set alone, and results are those of rows told apart."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(7, " ".join(w if j != i % 120 else f"x{i}" for j, w in enumerate(base))) for i in range(240)]
    rows += rows[:20] + [(None, rows[0][1]), (7, None), (7, "")]
    read = []

    def watched(docs, *args, **kwargs):
        if "copies" in docs.columns:
            read.append(docs)
        return map_texts(docs, *args, **kwargs)

    map_texts = jaccard.map_texts
    monkeypatch.setattr(jaccard, "map_texts", watched)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 3, 90, 100)
    assert read[0].count() == 260  # 240 texts, 20 of them twice

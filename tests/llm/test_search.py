import math
import random
from collections import Counter, defaultdict

import numpy as np

from verbatlas.llm import search
from verbatlas.llm.search import Segment, build_lists, search_items, terms_of

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "É", "ﬁn", "日本"]


def some_text(rng, n):
    return " ".join(rng.choices(WORDS, [1] * 60 + [40, 25, 3, 3, 3], k=n))


def by_hand(docs, items, k):
    """(item, rank, id, score) by scoring every document for every item."""
    held = [(i, terms_of(None if t is None else t.encode())) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_all, l_all = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in held:
            tf, m = Counter(t), 50 + (50 * len(t) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in set(terms_of((text or "").encode())) if tf[x])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    assert terms_of("Ab-c9_d É日x'y".encode()) == [b"ab", b"c9", b"d", "É日x".encode(), b"y"]
    assert terms_of(None) == terms_of(b"") == terms_of(b" .,!\x00") == []


def test_ranks_equal_scoring_every_document(spark, monkeypatch):
    """Several segments a task, ties at the last rank, copies, nulls, repeated rows, names that clash."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", 70)
    rng = random.Random(2)
    docs = [(i, some_text(rng, rng.choice([1, 5, 40, 300]))) for i in range(700)]
    copy = some_text(rng, 30)
    docs += [(i, copy) for i in range(1000, 1120)] + [(None, copy), (5, docs[5][1]), (5, "the w1"), (2000, None), (2001, ""), (2002, "?!"), (None, None)]
    rng.shuffle(docs)
    items = [(i, some_text(rng, rng.randrange(1, 20))) for i in range(25)] + [(90, copy), (91, copy), (92, ""), (None, "w3 W3 THE"), (93, "unheard"), (94, None)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, terms int").repartition(3)
    asked = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    for blocks in (1, 3):
        monkeypatch.setattr(search, "ITEM_BYTES", 8 << 20 if blocks == 1 else 1000)
        got = sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in search_items(frame, asked, 50).collect()], key=str)
        assert got == by_hand(docs, items, 50)


def test_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "name string, body string")
    items = spark.createDataFrame([("q", "x")], "q string, t string")
    got = search_items(docs, items, 2, "name", "body", "q", "t").collect()
    assert [(r.q, r["rank"], r.name) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]
    assert search_items(docs.limit(0), items, 2, "name", "body", "q", "t").count() == 0
    assert search_items(docs, items.limit(0), 2, "name", "body", "q", "t").count() == 0


def segment_of(spark, docs, vocabulary, n_docs, n_terms):
    row = build_lists(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1), vocabulary).collect()[0]
    return Segment(np.array(row.terms), np.array(row.counts), bytes(row.lists), np.full(len(vocabulary), 700), n_docs, n_terms)


def test_skipping_loses_nothing_above_the_threshold(spark):
    rng = random.Random(4)
    docs = [some_text(rng, 60) for _ in range(900)]
    vocabulary = {w.encode(): i for i, w in enumerate(sorted({x.decode() for d in docs for x in terms_of(d.encode())}))}
    found = segment_of(spark, docs, vocabulary, 900, 54000)
    for terms in ([0, 1, 2], list(range(len(vocabulary))), [vocabulary[b"the"], vocabulary[b"of"]]):
        places, scores = found.search(terms, 1)
        whole = dict(zip(places.tolist(), scores.tolist(), strict=True))
        for least in sorted(scores.tolist())[:: len(scores) // 7 + 1]:
            part = dict(zip(*(x.tolist() for x in found.search(terms, least)), strict=True))
            assert part == {p: s for p, s in whole.items() if s >= least}


def test_short_lists_are_summed_and_long_blocks_skipped(spark, monkeypatch):
    """A rare word lifts the threshold; then only the blocks that may reach it are opened in the long list."""
    docs = ["the " * 3 + "pad " * 20] * 640
    docs[300] = "gold the"
    vocabulary = {b"the": 0, b"gold": 1}
    found = segment_of(spark, docs, vocabulary, 640, 640 * 23)
    opened = defaultdict(int)
    looked_up = np.searchsorted

    def counted(places, at, *rest):
        opened[len(places)] += len(at)
        return looked_up(places, at, *rest)

    places, scores = found.search([0, 1], 1)
    assert len(places) == 640
    monkeypatch.setattr(np, "searchsorted", counted)
    places, _ = found.search([0, 1], int(scores.max()))
    assert places.tolist() == [300] and opened == {640: 1}  # of one block a single document may still reach it

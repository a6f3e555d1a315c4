"""Similar sets against comparing every pair."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import derive as D
from verbatlas.plans import catalogue


def families(rng, n):
    """Sets around some seeds, so that many pairs lie near the threshold; frequent items stand in most of them."""
    seeds = [[rng.randrange(5000) for _ in range(rng.randrange(2, 40))] for _ in range(n // 6)]
    sets = []
    for _ in range(n):
        own = set(rng.choice(seeds))
        for x in list(own):
            if rng.random() < 0.15:
                own.discard(x)
                own.add(rng.randrange(5000))
        sets.append(own | {x for x in range(-6, 0) if rng.random() < 0.7})
    return sets


@pytest.mark.parametrize("threshold,least_shared", [(0.3, 1), (0.6, 1), (0.8, 6), (1.0, 1)])
def test_packed_sets_equal_every_pair(spark, threshold, least_shared):
    sets = families(random.Random(int(threshold * 10)), 220)
    sets += [set(sets[0]), {7}, {7}, {8}]
    frame = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "k long, s array<long>").repartition(3)
    want = {}
    for (a, x), (b, y) in combinations(enumerate(sets), 2):
        shared = len(x & y)
        if shared >= least_shared and shared / len(x | y) >= threshold - 1e-12:
            want[a, b] = (shared, len(x), len(y))
    got = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in D.similar_packed(frame, threshold, least_shared).collect()}
    assert got == want and len(want) > 1
    items = spark.createDataFrame([(k, f"i{x}") for k, s in enumerate(sets) for x in s] * 2 + [(0, None)], "unit_id long, item string")  # repeated rows, a null
    assert {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in D.similar_sets(items, threshold, least_shared).collect()} == want
    members, links = D.packed_groups(frame, threshold, least_shared)
    assert {(r.a, r.b) for r in D.expanded(members, links).collect() if r.shared >= least_shared} == set(want)


def test_no_sets(spark):
    none = spark.createDataFrame([], "k long, s array<long>")
    assert D.similar_packed(none, 0.5).count() == 0 and D.packed_groups(none, 0.5)[0].count() == 0
    assert D.similar_packed(spark.createDataFrame([(1, [])], "k long, s array<long>"), 0.5).count() == 0


def test_copies_are_members_and_pairs_only_on_request(spark):
    base = [f"w{i}" for i in range(30)]
    near = base[:20] + ["x", "y"] + base[22:]
    texts = [base] * 4 + [near] * 3 + [["a", "b"], None, []]
    units = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "unit_id long, text string")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    few = sorted(tuple(r) for r in D.near_duplicates(units, words).collect())
    assert [(r[0], r[1], r[6]) for r in few] == [(0, 4, False), (4, 0, False)]
    assert few[0][4:6] == (["w20", "w21"], ["x", "y"]) and few[1][4:6] == (["x", "y"], ["w20", "w21"])
    assert {(r.key, r.rep, r.copies) for r in D.duplicate_groups(units, words)[0].collect()} == {(i, 0, 4) for i in range(4)} | {(i, 4, 3) for i in range(4, 7)}
    every = {(r.a, r.b): r.identical for r in D.near_duplicates(units, words, expand=True).collect()}
    assert every == {(a, b): (a < 4) == (b < 4) for a in range(7) for b in range(7) if a != b}


def test_parallels_list_what_is_shared(spark):
    rows = [(u, t) for u, ts in {1: "abcdefz", 2: "abcdegz", 3: "abz", 4: "qrstuz", 5: "qrstuz"}.items() for t in ts] + [(1, "a"), (None, "a"), (3, None)] + [(9, "z")] * 10
    found = D.content_parallels(spark.createDataFrame(rows, "unit_id long, term string"), common=10)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 5, 5 / 7, list("abcde"), ["f"], ["g"]), (4, 5, 5, 1.0, list("qrstu"), [], [])]


def test_registered_query_lists_every_pair(spark, tmp_path):
    """Copies, texts whose sets are equal though their words are not, and near ones; held against comparing every pair."""
    base = [f"w{i}" for i in range(30)]
    texts = [base] * 5 + [base[:20] + ["x", "y"] + base[22:]] * 3 + [["a", "b", "a", "b", "a"], ["a", "b", "a", "b", "a", "b"], ["b", "a", "b", "a"]] + [["a", "b"]] * 2 + [None]
    rows = [(i, None if t is None else " ".join(t), "en", "src1", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} if t and len(t) > 3 else None for t in texts]
    want = set()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            if a != b and x and y and len(x & y) / len(x | y) >= 0.6:
                only = [" ".join([w for w in texts[p] if w not in texts[q]][:12]) for p, q in ((a, b), (b, a))]
                want.add((a, b, len(x & y), round(len(x & y) / len(x | y), 6), *only, texts[a] == texts[b]))
    assert (8, 9) in {r[:2] for r in want}
    found = list(map(tuple, catalogue.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()))
    assert set(found) == want and len(found) == len(want)


def test_copies_in_blocks(spark):
    units = spark.range(50).select(F.col("id").alias("unit_id"), F.when(F.col("id") < 40, "a b c d e f g h").otherwise("a b c d e f g i").alias("text"))
    words = F.split("text", " ")
    members, pairs = D.duplicate_groups(units, words)
    texts = D.equal_texts(units, words, 4)
    one = members.join(texts.where("key = rep").select("key"), "key")
    told = pairs.select("a", "b", "shared", "score", F.array(F.lit("h")).alias("only_a"), F.array(F.lit("i")).alias("only_b"), F.lit(False).alias("identical"))
    found = [(r.a, r.b, r.identical) for r in D.among_copies(told, one, texts, block=7).collect()]
    assert len(found) == len(set(found)) == 40 * 39 + 10 * 9 + 40 * 10
    assert all(same == ((a < 40) == (b < 40)) for a, b, same in found)

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import claims as H
from verbatlas.operators import derive as D
from verbatlas.operators import evidence as E
from verbatlas.operators import lexical as L
from verbatlas.operators import passages as N
from verbatlas.operators import retrieval as R
from verbatlas.operators import vectors as V
from verbatlas.operators import workspace as W
from verbatlas.operators.components import connected_components
from verbatlas.operators.filters import CorpusFilter, FeatureFilter


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = ["al", "be", "ce", "de", "ef", "ge"]
    units = [(s * 100 + n, s, n, n // 4, "A" if s % 2 else "B", s, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for s in (1, 2, 3) for n in range(1, 13)]
    frame = spark.createDataFrame(units, "unit_id long, section_id int, unit_num int, block_id int, cohort string, ordinal int, text string")
    frame = frame.withColumn("n_words", F.size(X.words(F.col("text"))))
    rest = [c for c in frame.columns if c != "text"]
    occ = frame.select(*rest, F.posexplode(X.words(F.col("text"))).alias("p", "term")).withColumn("position", F.col("p") + 1).drop("p")
    return units, frame, occ


def test_totals_do_not_depend_on_the_page(corpus):
    units, frame, occ = corpus
    found = occ.where("term = 'al'")
    total = sum(u[-1].split().count("al") for u in units)
    assert R.totals(found).first().total == total
    assert R.page(found, limit=3).count() == 3 and R.page(found, limit=0).count() == 0 and R.page(found, limit=None).count() == total
    assert sum(r.total for r in R.by(found, "cohort").collect()) == total
    assert sum(r.matches for r in R.merged(found).collect()) == total


def test_filters_narrow(corpus):
    _, frame, occ = corpus
    everything = R.totals(R.matching(occ, frame, terms=["al"])).first().total
    narrow = R.totals(R.matching(occ, frame, terms=["al"], filters=CorpusFilter(sections=[1], cohort="A", words_min=2, words_max=100, unit_min=0, ordinal_min=1, ordinal_max=9))).first().total
    assert 0 < narrow < everything
    assert R.totals(R.matching(occ, frame, terms=["al"], filters=CorpusFilter(sections=[]))).first().total == everything
    assert R.totals(R.matching(occ, frame, terms=["al"], filters=CorpusFilter(not_sections=[1, 2, 3]))).first().total == 0


def test_feature_filter_leaves_out_affixes(spark):
    frame = spark.createDataFrame([("x", True, False), ("x", False, None), ("y", None, None)], "tag string, is_prefix boolean, is_suffix boolean")
    assert FeatureFilter((("tag", "x"),)).apply(frame).count() == 1
    assert FeatureFilter((), True).apply(frame).count() == 3


def test_phrase_tiers(spark):
    units = spark.createDataFrame([(1, "الرحمن الرحيم"), (2, "ٱلرَّحۡمَٰنِ"), (3, "x")], "unit_id long, text string")
    exact = {r.unit_id: r for r in R.phrase_search(units, "الرحمن").collect()}
    assert set(exact) == {1, 2} and exact[1].tier == "exact"
    loose = R.phrase_search(units, "الرحمان").collect()
    assert {r.unit_id for r in loose} == {1, 2} and {r.tier for r in loose} == {"loose"}
    with pytest.raises(ValueError):
        R.phrase_search(units, " ")


def test_bm25_against_formula(spark):
    import math

    docs = {0: "a a b", 1: "b c", 2: "", 3: "a c c c"}
    lengths, postings = L.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), X.words(F.col("text")))
    got = {r.doc_id: r.score for r in L.bm25_topk(["a", "c", "a"], lengths, postings, 10).collect()}
    avg = sum(len(t.split()) for t in docs.values()) / 4
    for d, t in docs.items():
        score = 0.0
        for q in ("a", "c"):
            tf, df = t.split().count(q), sum(q in x.split() for x in docs.values())
            if tf:
                score += math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / avg))
        assert got.get(d, 0) == pytest.approx(score)
    batch = L.bm25_batch(spark.createDataFrame([(7, ["a", "c"])], "query_id long, terms array<string>"), lengths, postings, 2).orderBy("rank").collect()
    assert [r.doc_id for r in batch] == sorted(got, key=lambda d: (-got[d], d))[:2]


def test_knn_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in V.knn_batch(frame.where("vec_id < 5"), frame, 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    one = [r.vec_id for r in V.topk(frame, rows[2][1], 4).collect()]
    assert got[2] == one and got[2][0] == 2 and len(got) == 5


def test_vector_store_checks_length(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    V.store(frame, str(tmp_path / "v"), "m1", 2)
    V.store(frame, str(tmp_path / "v"), "m2", 2)
    V.store(frame, str(tmp_path / "v"), "m1", 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    with pytest.raises(Exception, match="not of length"):
        V.store(frame, str(tmp_path / "v"), "m1", 3)


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_similar_sets_finds_all_pairs(spark, threshold):
    rng = random.Random(5)
    sets = {i: {f"x{rng.randrange(14)}" for _ in range(rng.randrange(1, 9))} for i in range(40)}
    items = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "unit_id long, item string")
    got = {(r.a, r.b): r.shared for r in D.similar_sets(items, threshold).collect()}
    expected = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert got == expected
    assert {(r.a, r.b) for r in D.similar_sets(items, threshold, df_max=3).collect()} <= set(expected)


def test_conditionals(spark):
    def unit(i, text):
        return [(i, p, w.split("/")[0], w.split("/")[0], "V" in w.split("/")[1:], next((t for t in w.split("/")[1:] if t in ("COND", "RSLT")), None), None) for p, w in enumerate(text.split(), 1)]

    rows = unit(1, "in/COND a b fa/RSLT c d") + unit(2, "in/COND x go/V y come/V z") + unit(3, "in/COND x go/V y") + unit(4, "lo/COND a fa/RSLT b in/COND c fa/RSLT d")
    frame = spark.createDataFrame(rows, "unit_id long, position int, text string, term string, is_verb boolean, tag string, form string")
    got = sorted((r.unit_id, r.particle, r.condition, r.consequence, r.confidence, r.word_start, r.word_end) for r in D.mine_conditionals(frame, {"in": "IN"}).collect())
    assert got == [(1, "IN", "in a b", "fa c d", 0.9, 1, 6), (2, "IN", "in x go y", "come z", 0.5, 1, 6), (4, "IN", "in c", "fa d", 0.9, 5, 8), (4, "lo", "lo a", "fa b", 0.9, 1, 4)]


def test_passages_merge_and_clip(spark):
    mentions = spark.createDataFrame([(1, n) for n in (1, 2, 7, 30)] + [(2, 4)], "section_id int, unit_num int")
    got = sorted((r.section_id, r.start, r.end, r.mentions) for r in N.merge_mentions(mentions, 4).collect())
    assert got == [(1, 1, 7, 3), (1, 30, 30, 1), (2, 4, 4, 1)]
    units = spark.createDataFrame([(1, n, n) for n in range(1, 40)], "section_id int, unit_num int, unit_id long")
    wide = sorted(r.unit_num for r in N.widen(N.merge_mentions(mentions, 4), units, 2).where("passage = 1 and section_id = 1").collect())
    assert wide == list(range(1, 10))


def test_support_and_violations_are_the_universe(spark, corpus):
    _, frame, occ = corpus
    claims = spark.createDataFrame([(1, "always_with", ["al"], ["be"], "unit", None, None), (2, "never_with", ["al"], ["be"], "unit", None, None), (3, "mostly_with", ["al"], ["be"], "section", "A", 0.5), (4, "distribution", ["al"], [], "unit", "A", 0.4), (5, "always_with", ["nothing"], ["be"], "unit", None, None), (6, "odd", ["al"], ["be"], "unit", None, None), (7, "always_with", [], ["be"], "unit", None, None)], "claim_id long, claim_type string, subject array<string>, object array<string>, scope string, cohort string, threshold double")
    valid, rejected = H.validate(claims)
    assert {r.claim_id: r.reason for r in rejected.collect()} == {6: "unknown claim type", 7: "no subject"}
    verdicts, lists = H.test_claims(valid, occ, frame)
    got = {r.claim_id: r for r in verdicts.collect()}
    assert got[5].verdict == "untestable" and got[1].violating == got[2].supporting and got[1].supporting == got[2].violating
    for r in got.values():
        assert r.violating + r.supporting == r.subject_units
    counts = {(r.claim_id, r.role): r.n for r in lists.groupBy("claim_id", "role").agg(F.count("*").alias("n")).collect()}
    for i in (1, 2, 3, 4):
        assert counts.get((i, "violating"), 0) == got[i].violating and counts.get((i, "supporting"), 0) == got[i].supporting
    roles = [r.role for r in H.describe(lists.where("claim_id = 1"), 3).collect()]
    assert roles == sorted(roles, key=lambda x: x != "violating")


def test_bibliography_order_and_counts(spark):
    rows = [("tafsir", "1:1", "b", "B", None, 774), ("ayah", "1:1", "q", "Q", None, None), ("ayah", "1:1", "q", "Q", None, None), ("ayah", "1:1", "q", "Q", None, None), ("tafsir", "1:1", "a", "A", None, 310), ("hadith", "5", "h", "H", "sahih", None)]
    got = E.bibliography(spark.createDataFrame(rows, "kind string, ref string, edition_slug string, edition_name string, grading string, death_year int")).collect()
    assert [(r.kind, r.edition_slug, r.times_cited) for r in got] == [("ayah", "q", 3), ("tafsir", "a", 1), ("tafsir", "b", 1), ("hadith", "h", 1)]


def test_placeholders_resolve_or_are_reported(spark):
    docs = spark.createDataFrame([(1, "a {{ayah:1:1}} b {{ayah:2:999}} c"), (2, "none"), (3, None), (4, "{{x:1|en}}{{x:1}}")], "doc_id long, text string")
    sources = spark.createDataFrame([("ayah", "1:1", "", "TEXT"), ("x", "1", "en", "E")], "kind string, ref string, arg string, text string")
    got = {r.doc_id: r for r in E.render_placeholders(docs, sources).collect()}
    assert got[1].text == "a TEXT b [UNRESOLVED ayah:2:999] c" and got[1].violations == ["ayah:2:999"] and got[1].resolved == 1
    assert got[2].text == "none" and got[3].text == "" and got[4].text == "E[UNRESOLVED x:1]"


def test_unverified_runs(spark):
    docs = spark.createDataFrame([(1, "he said الحمد لله رب العالمين"), (1, "قال كلمة اخرى جديدة"), (2, "plain")], "run_id long, text string")
    verified = spark.createDataFrame([(1, "ٱلحمدُ لله ربِّ العالمين"), (1, None)], "run_id long, text string")
    assert [r.run for r in E.unverified_runs(docs, verified, form=None).collect()] in (["قال كلمة اخرى جديدة"], ["الحمد لله رب العالمين", "قال كلمة اخرى جديدة"])


def test_golden_kinds(spark):
    rows = [("a", "count", "3", None, "3", None), ("b", "min_value", "4", None, "3", None), ("c", "refs_exact", None, ["x", "y"], None, ["y", "x", "x"]), ("d", "refs_include", None, ["x"], None, ["y"]), ("e", "verdict", "refuted", ["v"], "refuted", ["w"]), ("f", "ordering", None, ["p", "q"], None, ["z", "p", "q"]), ("g", "partition", None, None, "5", ["2", "3"]), ("h", "no_fabrication", None, None, None, []), ("i", "render_fails", "bad", None, None, ["a bad one"]), ("j", "odd", None, None, None, None)]
    expected = spark.createDataFrame([(i, "t", k, v, x) for i, k, v, x, _, _ in rows] + [("z", "t", "count", "1", None)], "item_id string, tier string, kind string, value string, items array<string>")
    actual = spark.createDataFrame([(i, v, x, None) for i, _, _, _, v, x in rows], "item_id string, value string, items array<string>, sample_complete boolean")
    got = {r.item_id: r.passed for r in E.golden_report(expected, actual).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": True, "g": True, "h": True, "i": True, "j": False, "z": False}


def test_version_chains(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (9, 77), (10, 9)]
    got = {r.id: (r.root, r.depth) for r in W.version_chains(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (9, 0), 10: (9, 1)}


def test_reviews_need_another_person(spark):
    findings = spark.createDataFrame([(1, 5, "in_review"), (2, 5, "in_review"), (3, 5, "draft")], "finding_id long, author_id long, status string")
    reviews = spark.createDataFrame([(1, 6, True, 1), (2, 5, True, 1), (3, 6, True, 1), (9, 6, True, 1)], "finding_id long, reviewer_id long, approve boolean, reviewed_at int")
    after, rejected = W.apply_reviews(findings, reviews)
    assert {r.finding_id: r.status for r in after.collect()} == {1: "approved", 2: "in_review", 3: "draft"}
    assert {r.finding_id: r.reason for r in rejected.collect()} == {2: "author reviews own finding", 3: "not in review", 9: "no such finding"}


def test_components_with_hubs_equal_union_find(spark):
    import random

    from verbatlas.operators import components

    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 300)] + [(400 + i, 500) for i in range(60)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(150)] + [(500, 299), (950, 950)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges + [(1, None)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(frame).collect()} == {x: find(x) for x in root}


def test_ranks_over_ranges_equal_one_sorted_list(spark):
    import random

    from pyspark.sql import functions as F

    from verbatlas.operators.ranks import numbered, running, suffix_minimum

    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(50)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    got = {r.id: (r._rank, r.total) for r in running(frame, [F.col("v").asc(), F.col("id").asc()], {"total": F.col("v")}).collect()}
    total, want = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        total += v
        want[i] = (n, total)
    assert got == want
    numbers = {r.id: r.n for r in numbered(frame, "g", "id", "n").collect()}
    for g in ("x", "y", None):
        assert [numbers[i] for i, own, _ in rows if own == g] == list(range(1, sum(own == g for _, own, _ in rows) + 1))
    least = {r.id: r.least for r in suffix_minimum(frame, F.col("v"), "id", "least").collect()}
    assert least == {i: min(v for j, _, v in rows if j >= i) for i, _, _ in rows}
    assert running(frame.limit(0), [F.col("v")]).count() == 0


def test_groups_of_equal_sets_give_the_same_as_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from verbatlas.operators import derive as D

    rng = random.Random(4)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(4, 25))]
        texts += [" ".join(words)] * rng.choice([1, 1, 3]) + ([" ".join([*words[:-1], "other"])] if rng.random() < 0.4 else [])
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")
    items = D.shingle_items(units, F.split("text", " "), 3, 4)
    pairs = D.similar_sets(items, 0.6)
    members, links = D.similar_groups(items, 0.6)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(D.expanded(members, links)) == rows(pairs) and pairs.count() > 50
    assert rows(D.group_clusters(members, links)) == rows(D.clusters(pairs))
    one, two = D.group_summary(members, links).first(), D.edge_summary(pairs).first()
    assert (one.pairs, one.identical, one.units) == (two.pairs, two.identical, two.units) and abs(one.mean_score - two.mean_score) < 1e-9

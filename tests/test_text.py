import pytest
from pyspark.sql import functions as F

from verbatlas.functions import text as X


def values(spark, rows, *cols):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{j} string" for j in range(len(rows[0]))))
    return [tuple(r)[1:] for r in frame.select("i", *cols).orderBy("i").collect()]


def test_marked_and_plain_spellings_are_equal(spark):
    got = values(spark, [("بِسْمِ",), ("بسم",), ("أَمَن",), ("إمن",), ("آمن",), ("ـبسمـ",), ("",), (None,)], X.search_form(F.col("c0")))
    assert got == [("بسم",), ("بسم",), ("امن",), ("امن",), ("امن",), ("بسم",), ("",), (None,)]


def test_loose_and_align_forms(spark):
    got = values(spark, [("ٱلْعَٰلَمِينَ",), ("الْعَالَمِينَ",), ("بالءاخرة",)], X.loose_form(F.col("c0")), X.align_form(F.col("c0")))
    assert got[0][0] == got[1][0] == "لعلمين"
    assert got[2][1] == "بالاخره"


def test_term_keys(spark):
    got = values(spark, [("ع-ل-م",), ("ع ل م",), ("علم",), ("Elm",), (" ",), (None,), ("سأل",), ("Q!",)], X.term_key(F.col("c0")))
    assert [g[0] for g in got] == ["علم", "علم", "علم", "علم", "", "", "سال", ""]
    assert values(spark, [("Elm",)], X.term_letters(F.col("c0")))[0][0] == ["ع", "ل", "م"]


def test_tokenisers(spark):
    got = values(spark, [("Don't STOP-9 é a قال",), (None,), ("",)], X.words(F.col("c0")), X.folded_words(F.col("c0")), X.tokens(F.col("c0")))
    assert got[0] == (["don", "t", "stop", "9", "é", "a", "قال"], ["don", "stop", "قال"], ["قال"])
    assert got[1] == ([], [], []) and got[2] == ([], [], [])


@pytest.mark.parametrize(("a", "b", "n", "expected"), [("x y z w", "x y z w", 3, 1.0), ("a b c", "d e f", 2, 0.0), ("a b", "a b", 3, 1.0), ("", "a", 3, 0.0), ("", "", 3, 0.0), ("a b c d", "a b c e", 3, 1 / 3)])
def test_shingles_and_jaccard(spark, a, b, n, expected):
    got = values(spark, [(a, b)], X.jaccard(X.shingles(X.words(F.col("c0")), n), X.shingles(X.words(F.col("c1")), n)))
    assert got[0][0] == pytest.approx(expected)


def test_counts_and_positions(spark):
    run = F.array(F.lit("a"), F.lit("b"))
    got = values(spark, [("a b a b c a b", "ab"), ("abab", "ab"), ("b", ""), ("", "ab")], X.occurrences_of(F.col("c0"), F.col("c1")), X.positions_of(X.words(F.col("c0")), run))
    assert got == [(0, [1, 2, 3, 4, 6, 7]), (2, []), (0, []), (0, [])]


def test_quoted_runs(spark):
    rows = [("typed: الحمد لله رب العالمين end",), ("one ٱلحمد word",), ("صبر and الصلاة",), ("یہ الحمد لله رب ہے",), ("ص ب ر",), (None,), ("الحمد لله\nرب العالمين",)]
    got = [g[0] for g in values(spark, rows, X.quoted_runs(F.col("c0")))]
    assert got == [["الحمد لله رب العالمين"], ["ٱلحمد"], [], ["الحمد لله رب"], [], [], []]


def test_anchors_placeholders_slugs(spark):
    text = "see [[2:255]] and [[root:علم]] with {{ayah:1:1}} or {{translation:2:3|en.x}}"
    t = F.col("c0")
    got = values(spark, [(text,), (None,)], X.anchors(t, X.UNIT_ANCHOR), X.anchors(t, X.TERM_ANCHOR), F.to_json(X.placeholders(t)), X.slug(t, 12), X.redacted(t))
    assert got[0] == (["2:255"], ["علم"], '[{"kind":"ayah","ref":"1:1","arg":""},{"kind":"translation","ref":"2:3","arg":"en.x"}]', "see-2-255-an", f"[{len(text)} chars]")
    assert got[1][:3] == ([], [], "[]")


def test_nfc(spark):
    assert values(spark, [("é",), (None,)], X.nfc(F.col("c0"))) == [("é",), (None,)]

import json

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import text as X
from verbatlas.operators import cooccurrence as C
from verbatlas.operators import distribution as B
from verbatlas.operators import evidence as E
from verbatlas.operators import graph as G
from verbatlas.sources import load as S
from verbatlas.streaming import telemetry as M


def test_editions_become_units(spark, tmp_path):
    main = {"quran": [{"chapter": 1, "verse": 1, "text": "بسم الله الرحمن الرحيم الحمد"}, {"chapter": 1, "verse": 2, "text": "رَبِّ"}, {"chapter": 9, "verse": 1, "text": "بسم الله الرحمن الرحيم براءة"}]}
    alt = {"quran": [{"chapter": 1, "verse": 1, "text": "ALT"}]}
    structure = {"chapters": [{"chapter": c, "name": "n", "arabicname": "a", "englishname": "E", "revelation": "Makki", "verses": [{"verse": v, "juz": 1, "ruku": 1, "page": 1} for v in (1, 2)]} for c in (1, 9)]}
    for name, data in (("main", main), ("alt", alt), ("structure", structure)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data), encoding="utf-8")
    ordinals = spark.createDataFrame([(1, 2), (9, 1)], "section_id int, ordinal int")
    units = S.build_units(S.read_edition(spark, str(tmp_path / "main.json")), S.read_edition(spark, str(tmp_path / "alt.json")), S.read_structure(spark, str(tmp_path / "structure.json")), ordinals)
    got = {r.unit_id: r for r in units.collect()}
    assert got[100001].alt_text == "ALT" and got[100002].alt_text == "رَبِّ" and got[100002].text_search == "رب" and got[100002].n_letters == 2
    assert got[100001].cohort == "makki" and got[100001].ordinal == 2
    stripped = {r.unit_id: r.text for r in S.strip_heading(units, ["بسم", "الله", "الرحمن", "الرحيم"], [9]).collect()}
    assert stripped[100001] == "الحمد" and stripped[900001].startswith("بسم")
    assert S.ordinal_report(ordinals, units).first().valid
    assert not S.ordinal_report(ordinals.withColumn("ordinal", F.lit(1)), units).first().valid


def test_annotation_lines_and_features(spark):
    lines = ["# comment", "", "1:1:1:1\tbi\tP\tPREF|P", "1:1:1:2\tsomi\tN\tROOT:smw|LEM:ism|MS|GEN|X:1", "1:1:2\tbad\tN\t", "1:1:3:1\tqala\tV\tPERF|VF:1|ROOT:qwl|3MP|MOOD:IND", "x:1:1:1\tq\tN\t", "1:1:4:1\tq\tV"]
    rows = S.parse_annotation(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {(r.position, r.seg): r.f for r in rows.withColumn("f", S.parse_features(F.col("features"))).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (4, 1)}
    assert got[1, 1].is_prefix and got[1, 1].tag == "P"
    f = got[1, 2]
    assert (f.term, f.lemma, f.gender, f.number, f.person, f["case"], f.features) == ("smw", "ism", "M", "S", None, "GEN", {"X": "1"})
    f = got[3, 1]
    assert (f.aspect, f.voice, f.person, f.gender, f.number, f.verb_form, f.mood) == ("PERF", "ACT", "3", "M", "P", "1", "IND")
    assert got[4, 1].voice is None and got[4, 1].features == {}


def test_dictionaries_and_stems(spark):
    occ = spark.createDataFrame([(1, 1, 1, None, None, "P", True, False, 1), (1, 1, 2, "ع-ل-م", "l1", "N", False, False, 2), (1, 2, 1, "علم", "l2", "N", False, False, 3), (2, 1, 1, None, None, "P", True, False, 4), (2, 1, 2, None, None, "X", False, False, 5)], "unit_id int, position int, seg int, term string, lemma string, coarse string, is_prefix boolean, is_suffix boolean, line_no int")
    terms, lemmas = S.dictionaries(occ)
    assert [(r.key, r.display, r.occurrences) for r in terms.collect()] == [("علم", "ع-ل-م", 2)]
    assert {r.lemma for r in lemmas.collect()} == {"l1", "l2"}
    stems = {(r.unit_id, r.position): (r.term, r.coarse) for r in S.lift_stems(occ).collect()}
    assert stems == {(1, 1): ("ع-ل-م", "N"), (1, 2): ("علم", "N"), (2, 1): (None, "X")}


def test_word_alignment_merges_and_skips(spark):
    words = spark.createDataFrame([(1, ["ab", "cd", "zz", "ef"]), (2, ["a"])], "unit_id int, words array<string>")
    tokens = spark.createDataFrame([(1, ["A", "B", "CD", "q", "EF"], ["a", "b", "cd", "q", "ef"]), (2, ["x"], ["x"])], "unit_id int, tokens array<string>, folded array<string>")
    got = sorted((r.unit_id, r.position, r.display) for r in S.align_words(words, tokens).collect())
    assert got == [(1, 1, "AB"), (1, 2, "CD"), (1, 4, "EF")]


def test_runs_first_records_and_upserts(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", "", "b", "a", None])], "g int, i int, t string")
    got = sorted((r.start, r.end, r.text, r.chunk_index) for r in S.collapse_runs(rows, "g", "i", "t").collect())
    assert got == [(0, 1, "a", 0), (3, 3, "b", 1), (4, 4, "a", 2)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w"), (3, "a")], "k int, v string")
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_external_documents_and_lexicon(spark, tmp_path):
    hadiths = {"metadata": {"name": "m"}, "chapters": [], "hadiths": [{"idInBook": 1, "arabic": "a", "english": {"narrator": "N:", "text": "t"}, "grade": "Sahih"}, {"idInBook": 1, "arabic": "second", "english": {"narrator": "", "text": ""}}, {"idInBook": 2, "arabic": "b", "english": {"narrator": "", "text": "u"}}]}
    (tmp_path / "h.json").write_text(json.dumps(hadiths))
    got = {r.number: r for r in S.external_documents(spark, str(tmp_path / "h.json"), "e").collect()}
    assert (got["1"].text, got["1"].grading, got["1"].translation) == ("a", "Sahih", "N: t") and got["2"].grading == "unknown"
    (tmp_path / "l.jsonl").write_text('{"root":"Elm","headword":"h","text":"t","ref":"r"}\n{"root":"zzz","headword":"i","text":"t2","ref":"r"}\n{"root":"x","headword":"j","text":" ","ref":"r"}\n')
    terms = spark.createDataFrame([("علم", "ع ل م")], "key string, display string")
    assert {r.headword: r.term for r in S.load_lexicon(spark, str(tmp_path / "l.jsonl"), terms).collect()} == {"h": "ع ل م", "i": None}
    log = S.provenance(spark, "step", [str(tmp_path / "h.json")], terms).first()
    assert log.rows == 1 and len(log.sha256) == 64 and log.step == "step"
    (tmp_path / "g.jsonl").write_text('{"id":"g1","tier":"t","kind":"count","question":"q"}\n')
    assert S.load_golden(spark, str(tmp_path / "g.jsonl")).first().id == "g1"


def test_gate_withholds_unknown_and_restricted(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, edition string")
    editions = spark.createDataFrame([("a", "open", True), ("b", "restricted", True)], "slug string, status string, available boolean")
    admitted, withheld = S.licence_gate(rows, editions, ["open"])
    assert [r.id for r in admitted.collect()] == [1] and sorted(r.id for r in withheld.collect()) == [2, 3, 4]
    assert {r.slug: r.shipped for r in S.audit_editions(rows, editions, ["open"]).collect()} == {"a": True, "b": False}
    units = spark.createDataFrame([(7, 1, 1)], "unit_id int, section_id int, unit_num int")
    texts = spark.createDataFrame([(1, 1, " t "), (1, 2, "u"), (1, 1, " ")], "section_id int, unit_num int, text string")
    assert [tuple(r) for r in S.load_texts(texts, units, "e").collect()] == [(7, "e", "t")]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "p")
    for kind, n in (("a", 3), ("b", 2), ("a", 1)):
        S.write_partition(spark.range(n).withColumn("kind", F.lit(kind)), path, "kind")
    assert {r.kind: r["count"] for r in spark.read.parquet(path).groupBy("kind").count().collect()} == {"a": 1, "b": 2}


def test_stream_index_takes_new_files_once(spark, tmp_path):
    src, index, state = (str(tmp_path / n) for n in ("src", "index", "state"))
    schema = "doc_id long, text string"
    for batch in ([(1, "a b a")], [(2, "b c")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        M.upkeep(stream, X.words(F.col("text")), index, state).awaitTermination()
    lengths, postings, df = M.read_index(spark, index)
    assert {r.term: r.df for r in df.collect()} == {"a": 1, "b": 2, "c": 1}
    assert {r.doc_id: r.length for r in lengths.collect()} == {1: 3, 2: 2} and postings.count() == 4


def test_late_rows_are_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "ts timestamp, k string, v double"
    rows = [[("2024-01-01 01:00:00", "a", 1.0)], [("2024-01-09 01:00:00", "a", 2.0)], [("2024-01-01 02:00:00", "a", 5.0), ("2024-01-20 00:00:00", "a", 1.0)], [("2024-01-20 01:00:00", "a", 1.0)]]
    for batch in rows:
        spark.createDataFrame(batch, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        M.stream_rollup(stream, ["k"], "ts", value=F.col("v")).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {str(r.window_start)[:10]: (r.spans, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-09": (1, 2.0)}


def test_npmi_of_terms_that_are_everywhere(spark):
    occ = spark.createDataFrame([(u, 1, 1, t) for u in range(6) for t in ("x", "y")] + [(0, 1, 1, "z")], "unit_id int, section_id int, block_id int, term string")
    r = C.associate(occ, occ, "x", "y").first()
    assert r.npmi == 1.0 and r.pmi == 0.0 and r.n_ab == 6
    assert C.associate(occ, occ, "z", "no").first().n_ab == 0
    assert [r.term for r in C.missing_terms(occ, ["x", "no"]).collect()] == ["no"]


def test_timeline_has_a_rest_bucket(spark):
    units = spark.createDataFrame([(i, i, 10, "A") for i in range(1, 15)], "section_id int, ordinal int, n_words int, cohort string")
    occ = spark.createDataFrame([(i, "t") for i in range(1, 15)], "section_id int, term string")
    got = {r.bucket: r.total for r in B.timeline(occ, units, ["t"], 4).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 3, 5: 2}


def test_graph_bridges(spark):
    occ = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (3, 2, "b")], "unit_id int, section_id int, term string")
    got = {r.level: (r.both, r.only_a, r.only_b) for r in G.bridges(occ, "a", "b", {"unit": ["unit_id"], "section": ["section_id"]}).collect()}
    assert got == {"unit": (1, 1, 1), "section": (1, 0, 1)}


def test_report_verdicts(spark):
    claims = spark.createDataFrame([(1, ["s1"], False), (2, [], False), (3, ["s1"], True)], "claim_id int, support array<string>, universal boolean")
    spans = spark.createDataFrame([("s1",)], "span_id string")
    retest = spark.createDataFrame([(3, "refuted")], "claim_id int, verdict string")
    status = E.claim_support(claims, spans, retest)
    assert {r.claim_id: r.status for r in status.collect()} == {1: "open", 2: "needs_evidence", 3: "refuted"}
    good, bad = spark.createDataFrame([(True,)], "resolves boolean"), spark.createDataFrame([(False,)], "resolves boolean")
    numbers = spark.createDataFrame([(0.5,)], "baseline double")
    assert E.report_verdict(status, good, numbers).first().verdict == "blocked"
    assert E.report_verdict(status.where("claim_id = 2"), good, numbers).first().verdict == "qualified"
    assert E.report_verdict(status.where("claim_id = 1"), good, numbers).first().verdict == "clear"
    assert E.report_verdict(status.where("claim_id = 1"), bad, numbers).first().verdict == "blocked"


@pytest.mark.parametrize("without", [True, False])
def test_registered_queries_have_unique_names(without):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if not without:
        assert "pipeline" in entry.queries() or entry.corpus_pipeline is None

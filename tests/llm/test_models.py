import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import batches, cotraining, language, licenses, media, suffix_tree

# -- language


WORDS = {"aa": ["kala", "moku", "nalu", "wai"], "bb": ["schrift", "tzung", "pfad", "acht"], "cc": ["tion", "ment", "able", "ing"]}


def language_docs(rng, n):
    docs = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        docs.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang))
    return docs


def test_languages_are_told_apart_and_junk_is_rejected(spark):
    docs = language_docs(random.Random(1), 300)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "qqxj zzvv wwyy xxqq jjzz", None), (None, "kala moku", "aa"), (1004, "É", None)]
    frame = spark.createDataFrame([(*d, "x") for d in docs + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify_held_out(frame).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in docs if got[i].held_out]
    assert len(right) > 30 and sum(right) / len(right) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in docs)
    assert all(not got[i].rejected and 0 <= got[i].score <= 1 for i, _, _ in docs)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1003].rejected and got[1003].lang_pred in WORDS and got[1004].lang_pred in WORDS
    assert got[None].held_out and len(got) == len(docs) + len(odd)


def test_languages_without_labels(spark):
    frame = spark.createDataFrame([(1, "kala", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify_held_out(frame).collect()] == ["und"]
    assert language.identify_held_out(frame.limit(0)).count() == 0


def test_centroids_are_the_nearest(spark):
    rows = language.tfidf([b" kala moku ", b" schrift tzung "], np.ones(language.DIMENSIONS, np.float32))
    model = language.Centroids(["x", "y"], rows, np.array([0.0, 0.0]), np.ones(language.DIMENSIONS, np.float32))
    names, scores, _ = model.predict([b"moku kala", b"tzung"])
    assert names == ["x", "y"] and scores[0] > 0.8


def test_fit_and_prediction_equal_plain_python(spark):
    """Document frequencies, IDF, and the nearest centroid of every text, by loops over n-grams."""
    docs = language_docs(random.Random(5), 150)
    docs += [(900, "KALA moku", None), (901, "schrift, pfad! 12", None), (902, None, "aa"), (903, "??", "bb")]
    model = language.fit_centroids(spark.createDataFrame(docs, "doc_id long, text string, lang string"))

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(letters)} ".encode() if letters else b""
        found = Counter()
        for n in language.LENGTHS:
            for i in range(len(padded) - n + 1):
                code = n
                for b in padded[i : i + n]:
                    code = (code * 257 + b) % 2**32
                found[(code * 2654435761) % 2**32 >> (32 - 14)] += 1
        return found

    learnt = [grams(t) for _, t, lang in docs if lang is not None and grams(t)]
    df = Counter(g for x in learnt for g in x)
    idf = {g: math.log((1 + len(learnt)) / (1 + df[g])) + 1 for g in range(language.DIMENSIONS)}
    assert model.idf == pytest.approx([idf[g] for g in range(language.DIMENSIONS)], rel=1e-5)
    assert set(model.langs) == set(WORDS) and len(model.langs) == 9
    names, scores, rejected = model.predict([(t or "").encode() for _, t, _ in docs])
    for i, (_, text, _) in enumerate(docs):
        vector = {g: math.log1p(n) * idf[g] for g, n in grams(text).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[g]) for g, v in vector.items()) / norm for c in model.vectors] if norm else []
        if not cosines:
            assert (names[i], scores[i], rejected[i]) == ("und", 0.0, True)
            continue
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert names[i] == model.langs[best] and scores[i] == pytest.approx(cosines[best], abs=1e-4)
        assert rejected[i] == (scores[i] < model.floors[best])


# -- suffix tree


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", f"r{rng.randrange(400)}"]) for _ in range(rng.randrange(0, 30)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "A a\tB\x0bb"), (503, docs[0][1]), (504, docs[0][1])]
    frame = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in suffix_tree.score_held_out(frame).collect()}
    words = {i: (t or "").lower().split() for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter()
    for i, w in words.items():
        if not held[i]:
            c.update(w)
            c["<end>"] += 1
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        tokens = [*w, "<end>"]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert got[i].score < 0
    assert got[503].score == got[504].score == pytest.approx(got[0].score)


def test_contexts_that_tell_more_are_kept_and_help(spark):
    rng = random.Random(2)
    docs = []
    for i in range(400):
        w = []
        while len(w) < 30:
            x = rng.choice("abcde")
            w += [x, x + x, rng.choice("fghij")] if rng.random() < 0.9 else [x]
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = suffix_tree.score_held_out(frame)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.75 * held[1]


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.3)) % 4000}" for _ in range(60)) for _ in range(300)]
    train = [*texts[:200], *texts[:40]]
    tree, model = suffix_tree.fit_suffix_tree(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in suffix_tree.score_texts(frame, tree, model).collect()}
    others = sorted(got[i] for i in range(40, 300))
    assert sum(got[i] > others[int(0.95 * len(others))] for i in range(40)) >= 38


def test_next_word_distributions_sum_to_one(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(i, " ".join(rng.choice(["a b", "c d e", "a c", "f"]) for _ in range(20))) for i in range(200)], "doc_id long, text string")
    tree, model = suffix_tree.fit_suffix_tree(frame)
    assert tree.longest >= 3
    befores = ["a", "c", "c d", "b a"]
    texts = [*befores, *(f"{b} {w}" for b in befores for w in "abcdef"), *(f"{b} unseen" for b in befores)]
    out = suffix_tree.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tree, model)
    got = {texts[r.doc_id]: r.score for r in out.collect()}
    ends = {t: suffix_tree_end(texts_of(frame), t) for t in texts}
    want, _ = brute_force_scores(texts_of(frame), texts)
    assert [got[t] for t in texts] == pytest.approx(want, rel=1e-6)
    for b in befores:  # the text so far, then every next word or the end
        so_far = got[b] - ends[b]
        total = 10 ** ends[b] + sum(10 ** (got[f"{b} {w}"] - ends[f"{b} {w}"] - so_far) for w in [*"abcdef", "unseen"])
        assert total == pytest.approx(1, abs=1e-5)


def texts_of(frame):
    return [r.text for r in frame.orderBy("doc_id").collect()]


def suffix_tree_end(train, text):
    """log10 probability that ``text`` ends where it does."""
    return brute_force_scores(train, [text], last=True)[0][0]


def brute_force_scores(texts, scored=None, last=False):
    """log10 probabilities of ``scored`` (or of ``texts``) under the states of every length that the texts' own counts give."""
    t = suffix_tree
    as_words = lambda x: ["<begin>", *(x or "").lower().split(), "<end>"]
    seqs = [as_words(text) for text in texts]
    n = Counter(tuple(s[i - k : i + 1]) for s in seqs for i in range(1, len(s)) for k in range(min(i, t.DEPTH) + 1))
    words = Counter(w for s in seqs for w in s[1:])
    starts = Counter({("<begin>",): len(seqs)})
    z = sum(words.values()) + len(words) + 1
    after_of = {}
    for g, x in n.items():
        if len(g) > 1:
            after_of.setdefault(g[:-1], {})[g[-1]] = x
    states, level = {}, [(c,) for c in [*words, "<begin>"] if c != "<end>"]

    def p(w, c):
        if not c:
            return (words[w] + 1) / z
        if c not in states:
            return p(w, c[1:])
        total, kept, after = states[c]
        if w in after:
            return (after[w] + t.SMOOTHING * p(w, c[1:])) / (total + t.SMOOTHING)
        beyond = 1 - sum(p(x, c[1:]) for x in after)
        return (total - kept + t.SMOOTHING * beyond) / ((total + t.SMOOTHING) * beyond) * p(w, c[1:])

    for depth in range(1, t.DEPTH + 1):
        found, tried = [], []
        for c in level:
            total = n[c] or starts[c]
            if total < t.LEAST_CONTEXT[depth]:
                continue
            tried.append(c)
            after = {w: x for w, x in after_of.get(c, {}).items() if x >= t.LEAST_NEXT[depth]}
            if depth == 1:
                mean = {w: total * p(w, ()) for w in after}
                after = {w: x for w, x in after.items() if x > 2 or x > mean[w] and x * math.log(x / mean[w]) - x + mean[w] >= t.NEXT_GAIN}
            if not after:
                continue
            expected = {w: p(w, c[1:]) for w in after}
            kept = sum(after.values())
            rest, other = (min(max(1 - x, 1e-12), 1) for x in (kept / total, sum(expected.values())))
            gain = sum(x / total * math.log(x / total / expected[w]) for w, x in after.items()) + rest * math.log(rest / other)
            if gain > max(t.LEAST_DIVERGENCE, (len(after) + t.CHANCE * math.sqrt(2 * len(after))) / (2 * total)):
                found.append((c, (total, kept, after)))
        states |= dict(found)
        level = [(*c, w) for c in tried for w in after_of.get(c, {}) if w != "<end>" and (*c[1:], w) in states]
    out = []
    for s in map(as_words, scored if scored is not None else texts):
        terms = [math.log10(p(s[i], tuple(s[max(0, i - t.DEPTH) : i]))) for i in range(1, len(s))]
        out.append(terms[-1] if last else sum(terms))
    return out, max(map(len, states), default=0)


@pytest.mark.parametrize("share", [2.0**-20, 0.02, 1.0])
def test_states_of_every_length_equal_brute_force_whatever_is_broadcast(spark, monkeypatch, share):
    rng = random.Random(5)
    passage = "we hold that a repeated passage of many words is learnt as a whole"
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    texts += [f"{' '.join(rng.choice('abcdefgh') for _ in range(5))} {passage} {rng.choice('abcd')}" for _ in range(12)]
    texts += [f"rare{i // 2} {' '.join(f'r{i // 2}x{k}' for k in range(8))} a b" for i in range(20)]
    monkeypatch.setattr(suffix_tree, "SHARE", share)
    monkeypatch.setattr(suffix_tree, "FLUSH", 500)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree, model = suffix_tree.fit_suffix_tree(frame)
    odd = [*texts, "nothing known here", "", None]
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), tree, model).collect()}
    want, deepest = brute_force_scores(texts, odd)
    assert deepest > 2 and tree.longest > 3
    assert [got[i] for i in range(len(odd))] == pytest.approx(want, rel=1e-6)


def test_a_part_meets_its_model_some_postings_at_a_time(monkeypatch):
    """Two million postings of a part in 40 values: what is held does not go with them, and the sums are those of all at once."""
    t = suffix_tree
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 20_000, np.uint64)
    gram = np.arange(20_000) % 2
    values = rng.random(20_000)
    model = t.pack([(keys, 8), (values.view(np.uint64), 8), (gram.astype(np.uint64), 1)])
    blobs = []
    for low in range(0, 40_000, 1000):
        row = np.sort(rng.integers(0, 1000, 50_000))
        wanted = np.where(rng.random(50_000) < 0.9, keys[rng.integers(0, 20_000, 50_000)], rng.integers(1, 1 << 62, 50_000, np.uint64))
        blobs.append((low, t.pack([(np.diff(row, prepend=0), 4), (wanted, 8), (np.full(50_000, 2), 4)]), None))

    def run() -> tuple[int, tuple]:
        tracemalloc.start()
        found = t.part_sums(iter([(None, None, model), *blobs]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, found

    peak, few = run()
    monkeypatch.setattr(t, "MET", 1 << 60)
    all_peak, every = run()
    assert peak < 40e6 < 150e6 < all_peak
    assert all(np.array_equal(a, b) for a, b in zip(few, every, strict=True)) and len(few[0]) == len(set(few[0].tolist())) > 39_000
    assert t.part_sums(iter(blobs[:1])) is None and t.part_sums(iter([(None, None, model)])) is None


def test_word_hashes_equal_their_polynomials():
    texts = [b"", b"a  Bc\xff\n", b" " * 70_000 + b"end", b"x" * 70_000 + b" y" * 40_000, b"w" * (batches._PIECE + 3) + b" z"]
    hashes, counts = batches.word_hashes(texts)
    assert counts.tolist() == [0, 2, 1, 40_001, 2]
    base, mask = int(batches._BASE), (1 << 64) - 1
    want = {}
    for w in {w for t in texts for w in batches.split_words(t)}:
        total, power = 0, 1
        for b in w:
            power = power * base & mask
            total = total + int(batches._BYTE[b]) * power & mask
        want[w] = int(batches.mixed(np.array([total + len(w) & mask], np.uint64))[0])
    assert hashes.tolist() == [want[w] for t in texts for w in batches.split_words(t)]


def test_scores_of_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score_held_out(frame).count() == 0


# -- media


def png(width, height, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


SAMPLES = {
    "image/png": png(2, 2, b"\0ab\0cd"),
    "image/gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xda\x00\x02abc\xff\xd9",
    "audio/wav": media.wav(b"\x01\x02\x03\x04"),
    "image/bmp": struct.pack("<2sIIII", b"BM", 58, 0, 54, 40) + bytes(40),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF",
    "application/gzip": __import__("gzip").compress(b"hello hello"),
    "audio/ogg": b"OggS\0\x06" + bytes(20) + b"\x01\x03abc",
}


def test_formats_are_found_carved_and_corrected(spark):
    junk = b"RIFF GIF89a BM \xff\xd8\xff \x89PNG PK\x03\x04"
    rows = [(i, blob, "text/plain") for i, blob in enumerate(SAMPLES.values())]
    rows += [(100, b"xx" + b"--".join(SAMPLES.values()) + b"tail", "a/b"), (101, junk, "a/b"), (102, None, "a/b"), (103, b"", None), (104, SAMPLES["image/png"][:-3], "image/png")]
    out = media.sniff_media(spark.createDataFrame(rows, "id long, media binary, declared string"))
    got = {r.id: r for r in out.collect()}
    for i, (kind, blob) in enumerate(SAMPLES.items()):
        assert (got[i].detected_type, got[i].media_length, got[i].type_corrected) == (kind, len(blob), True)
    assert [(e.type, e.length) for e in got[100].embedded] == [(k, len(b)) for k, b in SAMPLES.items()]
    for i in (101, 102, 103, 104):
        assert got[i].media_length is None and not got[i].embedded and not got[i].type_corrected
    carved = {r.carved_type: bytes(r.carved) for r in media.carve(out.where("id = 100")).collect()}
    assert carved == SAMPLES


def test_media_end_where_their_last_part_ends():
    import io
    import time
    import zipfile

    pdf = b"%PDF-1.5\nstartxref\n0\n%%EOF\nmore\nstartxref\n9\n%%EOF\nupdate\nstartxref\n7\n%%EOF"
    assert media.sniff(pdf + b"\n" + pdf) == [("application/pdf", 0, len(pdf)), ("application/pdf", len(pdf) + 1, len(pdf))]
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", "hello")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", inner.getvalue())
    found = media.sniff(outer.getvalue())
    assert found[0] == ("application/zip", 0, len(outer.getvalue())) and [n for k, _, n in found[1:] if k == "application/zip"] == [len(inner.getvalue())]
    bomb = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = bomb.compress(bytes(50_000_000)) + bomb.flush()
    assert media.sniff(packed + b"tail") == [("application/gzip", 0, len(packed))]
    start = time.perf_counter()
    for mark in (b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x00"):
        assert media.sniff(mark * 200_000) == []
    assert time.perf_counter() - start < 30


def test_columns_of_the_same_names_are_replaced(spark):
    frame = spark.createDataFrame([(1, SAMPLES["image/png"], "a/b", "mine", 5)], "id long, media binary, declared string, embedded string, media_length int")
    row = media.sniff_media(frame).first()
    assert row.media_length == len(SAMPLES["image/png"]) and row.embedded == [] and row.detected_type == "image/png"


def test_texts_survive_storage(spark):
    texts = ["", "a", "x" * 576, "y" * 577, "é" * 300, None, "%PDF- RIFF"]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.media_features(media.sniff_media(media.store_texts(frame))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.wav(payload)), hashlib.sha256(media.wav(payload)).hexdigest())
        assert r.detected_type == "audio/wav" and r.type_corrected
    assert got[None].feature == got[1].feature and got[0].payload_sha256 == got[5].payload_sha256


# -- licenses


def base_by_hand(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.BASE:
        found += [(i, label) for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), sorted(found)


TEXTS = [
    "Released under the MIT License.", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: Apache-2.0", "Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0",
    "mit\nlicense mit license", "permit license", "", None, "all rights reserved " * 3, "the license of MIT", "général public license", "MIT-license/apache license",
]


def test_base_phrases_and_labels(spark):
    frame = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(frame)).collect()}
    for i, t in enumerate(TEXTS):
        n, found = base_by_hand(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(a for a, _ in found), max(a for a, _ in found)) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert {x for _, x in found} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "gpl,lgpl" and got[2].labels == "apache" and got[2].score == 1.0 and got[6].labels == ""


def test_overlaps_are_resolved_by_priority_and_containment():
    rules, _ = licenses.compiled()
    assert 250 < len(rules) < 600
    text = "licensed under the gnu lesser general public license version 2.1"
    found = [(rules[i][0].label, rules[i][0].kind) for _, _, i in licenses.detect(text)]
    assert ("gpl", "name") not in found and found[0] == ("lgpl", "grant")
    for r, pattern in rules:
        for m in pattern.finditer(text):
            assert r.keyword in text[: m.end()]


def test_every_keyword_occurs_in_what_its_pattern_matches():
    for f in licenses.FAMILIES:
        assert f.word == f.word.lower() and f.site == f.site.lower()
    rules, _ = licenses.compiled()
    samples = {"apache": "apache license", "bsd-3-clause": "new bsd license", "mit": "mit license", "lgpl": "gnu library general public license"}
    for r, pattern in rules:
        if r.kind == "name" and r.label in samples and pattern.search(samples[r.label]):
            assert r.keyword in samples[r.label] or r.label == "lgpl"


def alternatives(pattern):
    """Strings that a rule's name pattern matches: every choice of its groups, with and without optional parts."""
    import re._parser as parser

    def made(tokens):
        out = [""]
        for op, arg in tokens:
            op = str(op)
            if op == "LITERAL":
                own = [chr(arg)]
            elif op == "IN":
                own = [next(chr(c) for c in range(97, 128) if re.match(in_class(arg), chr(c)))] if str(arg[0][0]) != "LITERAL" else [chr(x) for k, x in arg if str(k) == "LITERAL"]
            elif op == "BRANCH":
                own = [x for branch in arg[1] for x in made(branch)]
            elif op == "SUBPATTERN":
                own = made(arg[-1])
            elif op == "MAX_REPEAT":
                own = ([""] if arg[0] == 0 else []) + made(arg[2])
            else:
                own = [""]
            out = [a + b for a in out for b in own]
        return out

    import re

    def in_class(arg):
        return {"RANGE": "[0-9]", "CATEGORY": r"\S"}[str(arg[0][0])] if str(arg[0][0]) != "RANGE" else f"[{chr(arg[0][1][0])}-{chr(arg[0][1][1])}0-9a-z]"

    return [x for x in made(parser.parse(pattern)) if re.fullmatch(pattern, x)]


def test_a_sweep_keeps_what_all_pairs_keep():
    rules, _ = licenses.compiled()
    rng = random.Random(4)

    def by_pairs(found):
        kept = []
        for x in sorted(found, key=lambda x: (-rules[x[2]][0].priority, x[0] - x[1], x[0], x[2])):
            if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
                kept.append(x)
        return sorted(kept)

    for _ in range(300):
        found = list({(a := rng.randrange(30), a + rng.randrange(1, 12), rng.randrange(len(rules))) for _ in range(rng.randrange(0, 40))})
        assert sorted(licenses.resolve(found, rules)) == by_pairs(found)


def test_many_detections_in_one_text_take_little_time():
    import time

    start = time.perf_counter()
    assert len(licenses.detect("mit license x " * 40_000)) == 40_000
    assert time.perf_counter() - start < 20


def test_every_sentence_opens_its_rule():
    rules, _ = licenses.compiled()
    distinct = {r.pattern for r in licenses.PHRASES} | {f.name for f in licenses.FAMILIES}
    assert len(licenses.PHRASES) > 150 and len(distinct) == len(licenses.PHRASES) + len(licenses.FAMILIES)
    for r in licenses.PHRASES:
        for made in alternatives(r.pattern.replace(r"\b", "").replace(".{0,", "x{0,").replace(".{1,", "x{1,"))[:200]:
            made = re_sub_classes(made)
            if re.search(r.pattern, made):
                assert any(word in made for word in (r.keyword, *r.others)), (r.pattern, made)


def re_sub_classes(text):
    return " ".join(text.split())


def test_malformed_bytes_and_identifiers(spark):
    frame = spark.sql("SELECT 1 AS doc_id, cast(unhex('4D4954206C6963656E736520FF') AS string) AS text UNION ALL SELECT 2, 'we use python-2.0 here' UNION ALL SELECT 3, 'SPDX-License-Identifier: Python-2.0'")
    got = {r.doc_id: r.labels for r in licenses.license_digest(licenses.scan_licenses(frame)).collect()}
    assert got == {1: "mit", 2: "", 3: "psf"}


def test_every_alternative_of_a_name_opens_its_rules():
    rules, _ = licenses.compiled()
    for f in licenses.FAMILIES:
        names = alternatives(f.name)
        assert names
        for name in names:
            assert any(word in name for word in (f.word, *f.others)), name
    labels = {rules[i][0].label for _, _, i in licenses.detect("Creative Commons Attribution-Share Alike 3.0; GNU Library General Public License; Zero-Clause BSD; Do What The Fun You Want To Public License")}
    assert {"cc-by-sa", "lgpl", "0bsd", "wtfpl"} <= labels


def test_wrapped_texts_give_the_same_detections():
    plain = "Permission is hereby granted, free of charge, to any person obtaining a copy; GNU Library General Public License version 2.0. All advertising materials mentioning features or use of this software, under the Apache License"
    want = licenses.detect(plain)
    assert len(want) > 3
    for gap in ("\n", "\r\n    ", "  ", "\t"):
        text = "x" + gap + plain.replace(" ", gap)
        got = licenses.detect(text)
        assert [(" ".join(text[a:b].split()), i) for a, b, i in got] == [(plain[a:b], i) for a, b, i in want]


def test_floors_hold_for_contexts_of_any_depth():
    assert [suffix_tree.least_of(suffix_tree.LEAST_CONTEXT, n) for n in (1, 2, 4, 5, 9)] == [2, 8, 8, 8, 8]
    assert [suffix_tree.least_of(suffix_tree.LEAST_NEXT, n) for n in (1, 2, 4, 5, 9)] == [2, 3, 3, 3, 3]


# -- quality


def quality_table(spark, n=600):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "of", "river", "stone"] if good else ["the", "of", "click", "buy***"]) for _ in range(rng.randrange(5, 40))]
        source = rng.choice(["s1", "s2"] if good else ["s3", "s2"])
        docs.append((i, " ".join(words), source, "en", len(" ".join(words)), good))
        if rng.random() < 0.3:
            labels.append((i, int(good)))
    return docs, spark.createDataFrame([d[:5] for d in docs] + [(9001, None, None, None, None), (9002, "", "s1", "en", 0), (None, "the river", "s1", "en", 9)], "doc_id long, text string, source string, lang string, n_chars long"), spark.createDataFrame(labels + [(77777, 1), (None, 0)], "doc_id long, quality int")


def test_views_teach_each_other(spark):
    docs, frame, labels = quality_table(spark)
    got = {r.doc_id: r for r in cotraining.quality_scores(frame, labels).collect()}
    assert len(got) == len(docs) + 3
    right = sum((got[d[0]].score >= 0.5) == d[5] for d in docs) / len(docs)
    assert right > 0.97
    assert all(0 <= getattr(r, c) <= 1 for r in got.values() for c in ("text_score", "meta_score", "score"))


def test_rounds_beat_the_first_views_on_rows_that_taught_nothing(spark):
    """Few labels; bad pages are told by layout to one view and by many different words to the other."""
    rng = random.Random(21)
    good_words, bad_words = [f"g{i}" for i in range(3000)], [f"b{i}" for i in range(3000)]
    docs, truth = [], {}
    for i in range(3000):
        good = rng.random() < 0.7
        words = [rng.choice(good_words if good else bad_words) if rng.random() < 0.25 else f"c{rng.randrange(300)}" for _ in range(30)]
        loud = not good and rng.random() < 0.7
        text = " ".join(w.upper() + "!!" if loud and rng.random() < 0.5 else w for w in words)
        docs.append((i, text, f"s{rng.randrange(5)}", "en", len(text)))
        truth[i] = good
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(90)], "doc_id long, quality int")
    right = {}
    for rounds in (0, 3):
        got = {r.doc_id: r for r in cotraining.quality_scores(frame, labels, rounds=rounds).collect()}
        right[rounds] = sum((got[i].score >= 0.5) == truth[i] for i in range(90, 3000)) / 2910
    assert right[3] > right[0] + 0.02 and right[3] > 0.93


def test_exchange_keeps_the_classes_balance():
    bins = lambda mean, n: np.bincount(np.clip(np.random.default_rng(1).normal(mean, 150, n).astype(int), 0, cotraining.BINS - 1), minlength=cotraining.BINS)
    hist = np.stack([bins(500, 200), bins(1500, 800), bins(500, 20_000) + bins(1500, 80_000)])
    low, high = cotraining.exchange_cuts(hist, 0.5, 0.8, 0.8)
    edges = np.arange(cotraining.BINS) / cotraining.BINS * 40 - 20
    assert hist[2][edges >= high].sum() == pytest.approx(40_000, rel=0.02)
    assert hist[2][edges < low].sum() == pytest.approx(10_000, rel=0.02)
    assert cotraining.exchange_cuts(np.stack([hist[1], hist[1], hist[2]]), 0.5, 0.5, 0.9) == (-math.inf, math.inf)


def test_counts_and_scores_equal_plain_python(spark):
    docs, frame, labels = quality_table(spark, 200)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(d[0], cotraining.text_features(d[1].encode()), sorted({1, 7, d[0] % 5}), known.get(d[0])) for d in docs]
    data = spark.createDataFrame(rows, "id long, text binary, meta array<int>, y int")
    counts = cotraining.class_counts(data, None)
    features = [(set(np.frombuffer(t, np.uint16).tolist()), set(m), y) for _, t, m, y in rows]
    for view, (found, sizes) in enumerate(counts):
        for c in (0, 1):
            own = [f[view] for f in features if f[2] == c]
            assert sizes[c] == len(own)
            want = Counter(x for f in own for x in f)
            assert {i: int(n) for i, n in enumerate(found[c]) if n} == dict(want)
    view = cotraining.View(*counts[0])
    got = view.raw([np.array(sorted(f[0])) for f in features], np.array([2 if f[2] is None else f[2] for f in features]))
    for f, raw in zip(features, got, strict=True):
        total = 0.0
        for x in f[0]:
            c = [counts[0][0][k][x] - (f[2] == k) for k in (0, 1)]
            n = [counts[0][1][k] - (f[2] == k) for k in (0, 1)]
            pooled = (sum(c) + 0.5) / (sum(n) + 1)
            rate = [(c[k] + cotraining.PULL * pooled) / (n[k] + cotraining.PULL) for k in (0, 1)]
            total += math.log(rate[1] / rate[0])
        assert raw == pytest.approx(total / math.sqrt(len(f[0])), rel=1e-9)


def test_labels_by_rules_over_plain_text(spark):
    """Labels and score of every text against all rules run over it without gates, all pairs of detections compared."""
    rules, _ = licenses.compiled()
    texts = [*TEXTS, "Licensed under the Apache License,\n  Version 2.0; BSD 3-Clause; GPLv3 or LGPL-2.1+", "this program is free software: you can redistribute it under the GNU General Public License v2", "cc by-nc-sa 4.0 and CC0 1.0 Universal"]
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        folded = re.sub(r"\s+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        found = [(m.start(), m.end(), r) for r, (_, p) in enumerate(rules) for m in p.finditer(folded)]
        better = lambda x: (-rules[x[2]][0].priority, x[0] - x[1], x[2])
        kept = [x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] and better(y) < better(x) for y in found)]
        base = {x for _, x in base_by_hand(text)[1]}
        assert got[i].labels == ",".join(sorted({rules[r][0].label for *_, r in kept} | base))
        assert got[i].score == max([0.0, *(rules[r][0].confidence for *_, r in kept), *([0.6] if base else [])])


def test_quality_without_labels_or_rows(spark):
    _, frame, labels = quality_table(spark, 40)
    got = cotraining.quality_scores(frame, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5}
    assert cotraining.quality_scores(frame.limit(0), labels).count() == 0

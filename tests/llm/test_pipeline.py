"""The pipeline against a brute-force version of every stage on a small table."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_native import brute_pairs, filled, smallest_capacity
from verbatlas.llm import language
from verbatlas.llm.sharding import KEY_BITS


def pareto_copies(docs):
    """key -> copies of (key, source, text), by the stated rule in plain Python."""
    size = {d: len((t or "").split()) for d, _, t in docs}
    text = {d: t or "" for d, _, t in docs}
    by = defaultdict(list)
    for d, s, _ in docs:
        by[s].append(d)
    targets = filled({s: sum(size[d] for d in ids) for s, ids in by.items()}, (5, 2, 1), 3)
    copies = {}
    for s, ids in by.items():
        low, high = 0.0, 1000.0  # expected copies: min(3, level * binary digits of the size), by bisection
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(3, level * size[d].bit_length()) * size[d] for d in ids) < targets[s] else (low, level)
        rate = {d: min(3, level * max(1, size[d].bit_length())) for d in ids}
        whole, part = {d: math.floor(rate[d]) for d in ids}, {d: rate[d] - math.floor(rate[d]) for d in ids}
        copies |= {d: whole[d] if size[d] else 0 for d in ids}
        budget = max(0.0, targets[s] - sum(whole[d] * size[d] for d in ids))
        order = []
        for d in ids:
            u = (int(hashlib.md5(f"mix-1|{d}|{hashlib.md5(text[d].encode()).hexdigest()}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if part[d] and size[d]:
                order.append(((u / (1 - u)) / (part[d] / (1 - part[d])), d))
        order = [d for _, d in sorted(order)]
        got, chosen = 0, set()
        for d in order:
            if got + size[d] > budget:
                break
            got += size[d]
            chosen.add(d)
        for _ in range(2):
            gap = budget - got
            rest = [d for d in order if d not in chosen and size[d] < 2 * gap]
            if rest:
                d = min(rest, key=lambda d: (abs(size[d] - gap), order.index(d)))
                got += size[d]
                chosen.add(d)
        for d in chosen:
            copies[d] += 1
    return copies


def make(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"aa": [f"ka{i}lo" for i in range(300)], "bb": [f"sch{i}ung" for i in range(300)]}
    items = [(i, " ".join(rng.choice(vocab["aa"]) for _ in range(20))) for i in range(5)]
    rows = []
    for i in range(220):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(vocab[lang]) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.25 and rows:
            words, lang = rng.choice(rows)[1].split(), rng.choice(rows)[2]
            if rng.random() < 0.5 and len(words) > 40:
                words[7] = "changed"
        if rng.random() < 0.08:
            words += items[rng.randrange(5)][1].split()
        text = " ".join(words)
        rows.append((i, text, lang, f"s{rng.randrange(4)}", len(text)))
    rows += [(900, "", "aa", "s1", 0), (901, None, None, None, None), (902, "12 34", "bb", "s2", 5)]
    sf = make(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r.doc_id for r in language.identify_held_out(docs).collect() if r.rejected}
    assert {900, 901, 902} <= rejected
    kept = [r for r in rows if r[0] not in rejected]
    assert len(kept) >= 215
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language"](spark, docs, sf)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in kept)

    groups = {d: c for _, d, _, _, c in brute([(r[0], r[1]) for r in kept], 5, 80, 100)}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    two = stage["near_duplicates"](spark, one, sf)
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in kept)

    dirty = {d for d, _ in brute_pairs([(r[0], r[1]) for r in kept], items)}
    assert dirty
    kept = [r for r in kept if r[0] not in dirty]
    three = stage["decontamination"](spark, two, sf)
    assert sorted(map(tuple, three.collect())) == sorted(kept)

    key = {r.doc_id: r._key for r in corpus_pipeline.keyed(three).collect()}
    by_key = pareto_copies([(key[r[0]], r[3], r[1]) for r in kept])
    copies = {d: by_key[k] for d, k in key.items()}
    four = stage["mixing"](spark, three, sf)
    assert Counter(r.doc_id for r in four.collect()) == Counter({d: n for d, n in copies.items() if n})
    assert four.columns == docs.columns

    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in copies.items() if n})
    text = {r[0]: r[1] for r in kept}
    total, by_key = Counter(), Counter()
    for r in out:
        total[r.shard] += len(text[r.doc_id].encode()) + 1
        by_key[int(hashlib.md5(text[r.doc_id].encode()).hexdigest()[: KEY_BITS // 4], 16)] += len(text[r.doc_id].encode()) + 1
    assert max(total.values()) == smallest_capacity([by_key[k] for k in sorted(by_key)], corpus_pipeline.N_SHARDS)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_tables_without_words_give_nothing(spark, tmp_path, rows):
    sf = make(spark, tmp_path, rows, [(1, None)])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_rows_are_decided_one_by_one_whatever_their_ids(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"ka{rng.randrange(900)}lo"
    text = lambda n=30: " ".join(word() for _ in range(n))
    item = text(20)
    clean = [(None, text(), "aa", "s1", 1), (None, text(), "aa", "s2", 1), (5, text(), "aa", "s1", 1), (5, text(), "aa", "s1", 2), (6, text(), "aa", "s2", 3)]
    dirty = [(None, f"{text()} {item}", "aa", "s1", 1), (5, f"{item} {text()}", "aa", "s1", 1)]
    twins = [(7, clean[4][1], "aa", "s2", 3), (None, clean[4][1], "aa", "s2", 3), clean[4], clean[0]]
    more = [(100 + i, text(), "aa", f"s{i % 2}", 0) for i in range(60)]
    sf = make(spark, tmp_path, clean + dirty + twins + more, [(1, item)])
    docs, stage = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(stage["language"](spark, docs, sf)) == rows(docs)
    deduped = stage["near_duplicates"](spark, docs, sf)
    assert rows(deduped) == sorted(clean + dirty + more, key=str)
    assert rows(stage["decontamination"](spark, docs, sf)) == sorted(clean + twins + more, key=str)
    mixed = Counter(map(tuple, stage["mixing"](spark, docs, sf).collect()))
    assert set(mixed) <= set(clean + dirty + twins + more) and all(n <= 3 * (2 if r in (clean[0], clean[4]) else 1) for r, n in mixed.items())


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontamination", "mixing"])
def test_stages_return_the_columns_of_documents(spark, tmp_path, name):
    sf = make(spark, tmp_path, [(None, "kalo melo kalo", "aa", "s1", 5)] * 3 + [(1, "", None, None, None)], [(1, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    assert out.count() == {"language": 0, "near_duplicates": 2, "decontamination": 4, "mixing": 3}[name]

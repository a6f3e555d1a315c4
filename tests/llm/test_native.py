import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verbatlas.llm import decontamination as dec
from verbatlas.llm.mixing import mix_to_targets, source_targets
from verbatlas.llm.sharding import PrefixSums, group_key, shard_documents


def rows_of(df, *cols):
    return sorted(([r[c] for c in cols] for r in df.collect()), key=str)


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


# -- sharding


def smallest_capacity(sizes, shards):
    """Brute force: tries every capacity."""
    for capacity in range(max(sizes, default=0), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
    return 0


def test_prefix_sums_find_the_smallest_capacity():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
        known = PrefixSums([(i, i, s, True) for i, s in enumerate(sizes)])
        for shards in (1, 2, 5):
            assert known.open_cells(shards) == (smallest_capacity(sizes, shards), [])


def test_shards_are_the_smallest_possible(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(0, 200) + str(rng.randrange(60)) for _ in range(300)] + [None, "", None, "é" * 30]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "a", "n"), (None, "a", "n")], "doc_id long, text string, shard string")
    got = shard_documents(docs, 5).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    shards = defaultdict(list)
    by_text = defaultdict(set)
    for r in got:
        shards[r.shard].append(r)
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    keys = spark.createDataFrame([(t,) for t in texts] + [("a",), ("a",)], "text string").groupBy(group_key(F.col("text")).alias("k")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).orderBy("k").collect()
    assert max(sum(r["size"] for r in own) for own in shards.values()) == smallest_capacity([r["b"] for r in keys], 5)
    assert set(shards) == set(range(5))


def test_a_group_larger_than_a_share_gets_its_own_shard(spark):
    docs = spark.createDataFrame([(i, "hot text" if i < 400 else f"t{i}") for i in range(1000)], "doc_id long, text string")
    got = shard_documents(docs, 8)
    assert no_python(got)
    rows = got.collect()
    hot = {r.shard for r in rows if r.doc_id < 400}
    rest = Counter()
    for r in rows:
        if r.doc_id >= 400:
            rest[r.shard] += r["size"]
    assert len(hot) == 1 and hot.isdisjoint(rest) and len(rest) == 7
    assert max(rest.values()) - min(rest.values()) < 60


def test_sharding_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- mixing


def filled(sizes, weights, cap):
    """Water filling in rounds: the excess over a cap is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * level >= cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, w[s] * level) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 5, "b": 5, "c": 5, "d": 700, None: 30}, {"é": 100, "z": 100, "A": 100, "~": 0}, {"a": 0}])
def test_targets_are_filled_to_caps(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(filled(sizes, (5, 2, 1), 3))


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    docs = [(i, f"s{rng.randrange(4) if rng.random() > 0.4 else 0}", " ".join(["w"] * rng.randrange(0, 60)), "x") for i in range(3000)]
    docs += [(9000, None, "a b c", "x"), (9001, None, None, "x"), (9002, "s1", " \n\t", "x"), (None, "s1", "a", "x"), (None, "s1", "a", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, target string")
    out = mix_to_targets(frame)
    assert no_python(out)
    got = out.collect()
    assert len(got) == len(docs)
    words, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken == r["size"] * r.copies and r.copies <= 3
        words[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(filled(dict(words), (5, 2, 1), 3))
    for s in words:
        assert abs(taken[s] - target[s]) <= max(60, 0.01 * target[s])
    again = mix_to_targets(frame.repartition(7))
    cols = ("doc_id", "source", "size", "taken")
    assert rows_of(out, *cols) == rows_of(again, *cols)


def test_inclusion_follows_the_stated_probabilities(spark):
    rng = random.Random(12)
    docs = [(i, "b" if i % 3 else "a", " ".join(["w"] * rng.choice([1, 3, 7, 12, 25]))) for i in range(24000)]
    got = mix_to_targets(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    size = {i: len(t.split()) for i, _, t in docs}
    for source, target in {r.source: r.target for r in got}.items():
        own = [r for r in got if r.source == source]
        words = Counter()
        for r in own:
            words[size[r.doc_id].bit_length()] += r["size"]
        low, high = 0.0, 10.0  # expected copies: min(3, level * digits), by bisection
        for _ in range(80):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(3, level * w) * n for w, n in words.items()) < target else (low, level)
        rates = {w: min(3, level * w) for w in words}
        assert len({round(r - int(r), 3) for r in rates.values()}) > 2
        for w, rate in rates.items():
            copies = [r.copies for r in own if size[r.doc_id].bit_length() == w]
            assert set(copies) <= {int(rate), int(rate) + 1}
            assert abs(sum(copies) / len(copies) - rate) < 4 * (0.25 / len(copies)) ** 0.5 + 2 / len(copies)


def test_a_third_of_equal_rows_is_drawn_row_by_row(spark):
    docs = [(None, "a", "one two three")] * 1000 + [(i, "ab"[i % 2], "w " * (i % 9)) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mix_to_targets(frame).collect()
    assert len(got) == 3000
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 16


def test_mix_of_empty_table(spark):
    assert mix_to_targets(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


# -- decontamination


def test_masks_survive_two_substitutions():
    for bad in itertools.combinations(range(dec.WINDOW), dec.WINDOW - dec.MATCHES):
        assert any(all(o + i not in bad for i in mask) for mask in dec.MASKS for o in range(dec.WINDOW - mask[-1]))


def test_short_masks_survive_one_substitution():
    for n in range(3, 12):
        masks = [dec.SHORT[n]] if n in dec.SHORT else dec.MASKS
        for bad in itertools.combinations(range(n), n - -(-n * dec.MATCHES // dec.WINDOW)):
            assert any(all(o + i not in bad for i in mask) for mask in masks for o in range(n - mask[-1])), (n, bad)


def brute_pairs(docs, items):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    found = set()
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            w = min(dec.WINDOW, len(b))
            need = -(-w * dec.MATCHES // dec.WINDOW)
            for x in range(-dec.WINDOW, len(a) + 1):
                for y in range(-dec.WINDOW, len(b) + 1) if len(b) >= 3 else ():
                    aligned = [(x + k, y + k) for k in range(dec.WINDOW) if 0 <= x + k < len(a) and 0 <= y + k < len(b)]
                    if sum(a[p] == b[q] for p, q in aligned) >= need:
                        found.add((d, i))
    return found


def test_finds_what_all_alignments_find(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 25][i]))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.8:
            planted = items[rng.randrange(12)][1].split()
            for at in rng.sample(range(len(planted)), min(len(planted), rng.randrange(0, 3))):
                planted[at] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            words[at:at] = planted
        docs.append((d, ("; " if d % 3 else " ").join(words).upper() if d % 2 else " ".join(words)))
    docs += [(90, None), (91, ""), (92, items[4][1] + " " + items[4][1])]
    out = dec.contaminated(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string"))
    assert no_python(out)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    exact = brute_pairs(docs, items)
    assert got == exact and len({i for _, i in got}) >= 10
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    again = dec.contaminated(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string"))
    assert no_python(again) and rows_of(again, *out.columns) == rows_of(out, *out.columns)


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "zz " * 30), (None, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d x f g h i j k l m")], "item_id long, text string")
    first = rows_of(dec.contaminated(docs, items), "doc_id", "item_id", "matched")
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    assert rows_of(dec.contaminated(docs, items), "doc_id", "item_id", "matched") == first
    assert [r[:2] for r in first] == [[1, 7], [None, 7]]
    assert dec.contaminated(docs.limit(0), items).count() == 0
    assert dec.contaminated(docs, items.limit(0)).count() == 0


def test_the_large_plan_shuffles_little(spark, tmp_path, monkeypatch):
    """Above the broadcast limit the shuffled bytes stay below 4 times the texts' own."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(400))) for i in range(1500)]
    items = [(i, " ".join(docs[i * 7][1].split()[50:80])) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dec, "FILTER_BITS", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dec.contaminated(table, spark.createDataFrame(items, "item_id long, text string"))
        got = {(r.doc_id, r.item_id) for r in out.collect()}
        stages, todo, written = [], [out._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if "AdaptiveSparkPlan" in node.nodeName():
                node = node.executedPlan()
            if "QueryStage" in node.nodeName():
                node = node.plan()
            metrics = node.metrics()
            if metrics.contains("shuffleBytesWritten"):
                written += metrics.apply("shuffleBytesWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got >= {(i * 7, i) for i in range(200)}
    assert 0 < written < 4 * sum(len(t) for _, t in docs)


def test_equal_rows_get_slots_of_their_own(spark):
    docs = [(None, "same")] * 500 + [(7, None)] * 50 + [(i, f"t{i}") for i in range(300)]
    out = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 4)
    assert no_python(out)
    by = defaultdict(list)
    for r in out.collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == len(docs) and all(sorted(x) == list(range(len(x))) for x in by.values())

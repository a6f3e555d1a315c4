import hashlib
import random
import zlib

import pytest

from verbatlas.llm.runs import find_runs, kept_words, periodic_runs, run_digest, with_planted_runs


def by_hand(words, least=24, exponent=3):
    """Every period, every stretch."""
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def stretch(rng, words):
    period = [b"%d" % rng.randrange(words) for _ in range(rng.randrange(1, 60))]
    if rng.random() < 0.3:
        period = period * rng.randrange(1, 3) + [b"x"]  # nearly a smaller period
    return [period[i % len(period)] for i in range(rng.randrange(6 * len(period) + 1))]


def some_words(rng, n):
    kinds, out = rng.choice([1, 2, 3, 10, 100]), []
    while len(out) < n:
        out += stretch(rng, kinds) if rng.random() < 0.5 else [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 30))]
    return out


def test_runs_equal_trying_every_period():
    rng, total = random.Random(3), 0
    for _ in range(250):
        texts = [some_words(rng, rng.randrange(400)) for _ in range(rng.randrange(1, 5))]
        texts += texts[:1]  # a copy beside it
        want = [by_hand(t) for t in texts]
        assert find_runs(texts) == want
        total += sum(map(len, want))
    assert total > 500


@pytest.mark.parametrize("least,exponent", [(3, 3), (24, 5), (100, 4)])
def test_other_bounds(least, exponent):
    rng = random.Random(least)
    for _ in range(60):
        text = some_words(rng, 300)
        assert find_runs([text], least, exponent) == [by_hand(text, least, exponent)]


def test_words_made_to_mislead():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(14):
        a, b = b, b + a
    thue = [b"a" if bin(i).count("1") % 2 else b"b" for i in range(1200)]
    for text in (b[:1000], thue, [b"a"] * 500, ([b"a"] * 30 + [b"b"]) * 20, [b"a"] * 23, [b"a"] * 24, []):
        assert find_runs([text])[0] == by_hand(text)
    with pytest.raises(ValueError):
        find_runs([[b"a"] * 30], exponent=2)


def test_every_length_of_period_is_found():
    for q in range(1, 140):
        period = [b"%d" % i for i in range(q)]
        n = max(24, 3 * q)
        text = [b"x", *(period[i % q] for i in range(n)), b"y"]
        assert find_runs([text]) == [[(1, n, q)]] and find_runs([text[:-2]])[0] == []


def test_long_texts_take_time_in_proportion():
    import time

    def took(n):
        texts = [[b"%d" % (i % (n // 3)) for i in range(n)], ([b"a"] * 30 + [b"b"]) * (n // 31)]
        start = time.perf_counter()
        assert find_runs(texts)[0] == [(0, n, n // 3)]
        return time.perf_counter() - start

    took(3000)
    assert took(600_000) < 40 * max(0.05, took(60_000))


def plant(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digest_equals_plain_python(spark):
    rng = random.Random(8)
    docs = [(i, " \t".join(x.decode() for x in some_words(rng, rng.choice([0, 3, 40, 200])))) for i in range(150)]
    docs += [(i, " ".join(f"é{rng.randrange(500)}" for _ in range(rng.randrange(200)))) for i in range(150, 400)]
    docs += [(1000, None), (1001, ""), (1002, " \n "), (None, "a " * 40), (None, None), (7, docs[7][1]), (1003, "b c " * 100_000)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, runs string, period string")
    got = sorted((tuple(r) for r in run_digest(periodic_runs(with_planted_runs(frame))).collect()), key=str)
    want = []
    for i, text in docs:
        words = (text or "").encode().split()
        words = plant(words, i) if i is not None else words
        runs = by_hand(words) if len(words) < 1000 else [(0, 200_000, 2)] if words[2:4] == words[:2] else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
        assert kept == kept_words(words, runs)
        row = (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
        want.append(row)
    assert got == sorted(want, key=str) and sum(r[1] > 0 for r in want) > 40


def test_general_form_and_empty_tables(spark):
    frame = spark.createDataFrame([("k", "say " + "no more " * 15 + "now")], "name string, body string")
    row = periodic_runs(frame, id_col="name", text_col="body").first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 2)] and row.collapsed == "say no more now" and row.n_words == 32
    assert periodic_runs(frame.limit(0), id_col="name", text_col="body").count() == 0
    assert with_planted_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0

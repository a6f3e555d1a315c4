import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import tokens
from verbatlas.llm.tokens import CountingTransducer, count_tokens, kinds_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    spec = open(PATH, encoding="utf-8").read()
    return CountingTransducer(spec, kinds_of(spec)), Tokenizer.from_file(PATH)


CASES = [
    "", " ", "\n\t", "Hello, World! don't we'll 'tis they're I'd've", "''s '' !!'s 'r 're've 'v 'l 'll 'x", "a1b22c  333", "ÀÉÎ é ΣΑΣ İstanbul ﬁ ß ẞ",
    "<|endoftext|>abc<|startoftext|> <|endoftext|", "\x1c\x1d\x1e\x1fabc\x1cdef", " x　y z\u0085w", "日本語 テキスト 한국어 العربية हिन्दी", "😀😀 a😀b", "x" * 3000, "́abc ́ def", "***$$$ thnder,%%% #@!",
]


def test_cases_equal_library(both):
    own, library = both
    for text in CASES:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbsStreErvVmMlLdD'’ \n\t 1234.,!?*éÉßñ́日😀<|>"), max_size=60))
def test_random_equal_library(both, text):
    own, library = both
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_every_code_point_counts_as_the_library_does(both):
    own, library = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [f"x{chr(c)}y" for c in points[i : i + 20_000]]
        assert own.counts([t.encode() for t in texts]) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose_like_the_whole(both, monkeypatch):
    own, library = both
    rng = random.Random(3)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(tokens, "CHUNK", size)
        for _ in range(60):
            text = "".join(rng.choice(["a", "b", "ing", "'s", "S", "é", "1", "!", "the"]) for _ in range(rng.randrange(1, 40)))
            maps = [own.chunk(x) for x in own.symbols(text.lower())]
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert own.total(maps) == want
            left = own.compose(own.compose(maps[0], maps[-1]), maps[0])
            right = own.compose(maps[0], own.compose(maps[-1], maps[0]))
            assert own.total([left]) == own.total([right])


def test_transitions_are_forgotten_and_compiled_again(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(tokens, "MOST_MOVES", 50)
    monkeypatch.setattr(tokens, "MOST_KNOWN", 20)
    texts = [f"word{i} thing{i * 7} unbelievable{i}ness" for i in range(200)]
    assert own.counts([t.encode() for t in texts]) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_long_text_without_white_space_takes_linear_time(both):
    import time

    own, library = both
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    start = time.perf_counter()
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert time.perf_counter() - start < 60


def test_operator_rows(spark, both):
    _, library = both
    texts = [*CASES[:6], None, "word " * 40_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (None, "a b", "y")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert count_tokens(docs, PATH).count() == len(texts) + 2
    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('6162FF6364') AS string) AS text")
    assert count_tokens(broken, PATH).first().n_tokens == len(library.encode("ab\ufffdcd", add_special_tokens=False).ids)
    assert count_tokens(docs.limit(0), PATH).count() == 0

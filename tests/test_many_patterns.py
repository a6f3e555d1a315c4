"""Terms of a large lexicon in many texts, against looking for every surface in every text."""

import random
import re

from pyspark.sql import functions as F

from verbatlas.operators.claims import resolve_terms


def by_hand(claims, lexicon):
    best = {}
    for claim, text in claims:
        for surface, term in lexicon:
            if None in (text, surface, term) or len(surface) < 3 or not re.search(r"[^\W_]", surface):
                continue
            found = re.search(rf"(?<![^\W_]){re.escape(surface)}(?![^\W_])", text.lower())
            if found:
                place = (-len(surface), surface, found.start() + 1)
                best[claim, term] = min(best.get((claim, term), place), place)
    out = []
    for claim in {c for c, _ in best}:
        own = sorted((at, term, surface) for (c, term), (_, surface, at) in best.items() if c == claim)
        out += [(claim, term, surface, at, i) for i, (at, term, surface) in enumerate(own, 1)]
    return sorted(out)


def test_tags_equal_looking_for_every_surface(spark):
    rng = random.Random(2)
    words = ["the", "old", "new", "york", "x-ray", "é", "of", "bb", "don't", "city"]
    some = lambda n: rng.choice([" ", " ", "  ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    lexicon = list({(some(rng.randrange(1, 5)), f"t{rng.randrange(30)}") for _ in range(60)}) + [("++ ++", "signs"), ("of", "short"), (None, "no"), ("the old", None), ("new york", "ny"), ("new york", "ny"), ("york city", "yc"), ("(the) new", "odd")]
    claims = [(i, some(rng.randrange(0, 14)).upper() if i % 3 else some(rng.randrange(0, 14))) for i in range(120)] + [(500, None), (501, ""), (502, "New York City"), (502, "the new york"), (503, "snew york new yorks (the) new.")]
    frame, known = spark.createDataFrame(claims, "claim_id long, text string"), spark.createDataFrame(lexicon, "surface string, term string")
    want = by_hand([c for c in claims if c[0] != 502], lexicon)
    rows = [tuple(r) for r in resolve_terms(frame, known).collect()]
    assert sorted(r for r in rows if r[0] != 502) == want and len(want) > 150
    assert {(r[1], r[2]) for r in rows if r[0] == 502} >= {("ny", "new york"), ("yc", "york city")}
    assert sorted(tuple(r) for r in resolve_terms(frame, known, most=1).collect() if r[0] != 502) == [r for r in want if r[4] == 1]
    assert resolve_terms(frame, known.limit(0)).count() == 0 == resolve_terms(frame.limit(0), known).count()


def test_a_large_lexicon_with_one_first_word(spark):
    """10^5 surfaces that all begin with "the": a join on the first word would try each of them on each of 2,000 texts."""
    n = 100_000
    lexicon = spark.range(n).select(F.concat(F.lit("the w"), F.col("id").cast("string")).alias("surface"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    claims = spark.range(2000).select(F.col("id").alias("claim_id"), F.concat(F.lit("The w"), (F.col("id") * 7).cast("string"), F.lit(" and the w"), F.col("id").cast("string"), F.lit("x")).alias("text"))
    got = resolve_terms(claims, lexicon)
    assert got.count() == 2000 and got.where((F.col("term") != F.concat(F.lit("t"), (F.col("claim_id") * 7).cast("string"))) | (F.col("at") != 1)).count() == 0

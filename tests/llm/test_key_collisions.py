"""Words and grams whose keys collide, of which large inputs have some."""

import math

from verbatlas.llm import suffix_tree
from verbatlas.llm.batches import word_hashes


def test_two_words_of_one_key_are_one_context(spark):
    one, other = "w325195", "w2323163"
    keys = suffix_tree.word_keys(word_hashes([one.encode(), other.encode()])[0])
    assert keys[0] == keys[1]
    texts = [f"{word} {after} x{i % 7} y{i % 5}" for i in range(40) for word, after in ((one, "alpha"), (other, "beta"), (f"z{i % 9}", "gamma"))]
    tree, model = suffix_tree.fit_suffix_tree(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert model.where("value IS NULL OR isnan(value)").count() == 0
    assert all(map(math.isfinite, tree.values))
    asked = [f"{one} alpha", f"{other} beta", f"{one} gamma", f"{other} alpha"]
    got = [r.score for r in suffix_tree.score_texts(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), tree, model).orderBy("doc_id").collect()]
    assert all(map(math.isfinite, got)) and max(got) < 0
    assert got[0] > got[2] + 1 and got[1] > got[2] + 1  # what follows either word is known after both

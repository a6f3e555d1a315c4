"""Shortest edit scripts against the whole table of common subsequences."""

import random

import pytest

from verbatlas.functions.diffs import changes, equal_runs
from verbatlas.operators import derive as D


def longest_common(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[-1], above[j + 1], above[j] + 1 if x == y else 0))
        above = row
    return above[-1]


def replay(a, found, b):
    out, at = [], 0
    for _, i, j, k, m in found:
        out += a[at:i] + b[k:m]
        at = j
    return out + a[at:]


@pytest.mark.parametrize("letters", [1, 2, 3, 7])
def test_scripts_are_shortest_and_lead_from_a_to_b(letters):
    r = random.Random(letters)
    for _ in range(1500):
        a, b = ([r.randrange(letters) for _ in range(r.randrange(16))] for _ in range(2))
        assert sum(n for *_, n in equal_runs(a, b)) == longest_common(a, b)
        found = changes(a, b)
        assert replay(a, found, b) == b
        assert all((op == "delete") == (k == m) and (op == "insert") == (i == j) for op, i, j, k, m in found)


def test_long_near_copies_cost_their_edits():
    r = random.Random(5)
    a = [r.randrange(4000) for _ in range(200_000)]
    b = [-1 if i % 5000 == 7 else x for i, x in enumerate(a)]
    assert changes(a, b) == [("replace", i, i + 1, i, i + 1) for i in range(7, len(a), 5000)]


def test_table_of_pairs(spark):
    rows = [(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["a"]), (3, [], None), (4, ["a"], ["a"]), (4, ["a"], ["a"])]
    got = D.word_diffs(spark.createDataFrame(rows, "id int, words_a array<string>, words_b array<string>")).orderBy("id").collect()
    assert [(r.id, r.edits, r.common, [tuple(o) for o in r.opcodes]) for r in got] == [
        (1, 3, 2, [("replace", "b", "x"), ("insert", "", "d")]), (2, 1, 0, [("insert", "", "a")]), (3, 0, 0, []), (4, 0, 1, []), (4, 0, 1, []),
    ]

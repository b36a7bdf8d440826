"""Pairs of large and small buckets against all pairs that share one."""
from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pandas as pd

from packloom.llm import shingle_join


def test_signatures_as_bits():
    sides = [pd.Series([[1, 5], [], [7]]), pd.Series([[5], [1, 7, 9], [8]])]
    left, right = shingle_join._bits(sides)
    assert [[bool((x & y).any()) for y in right] for x in left] == [[True, True, False], [False] * 3, [False, True, False]]


def test_pairs_of_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SMALL", 3)
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    draw = random.Random(5)
    held = {sig: draw.sample(range(30), size) for sig, size in enumerate([2, 3, 3, 9, 12, 17, 17, 17, 25])}
    comp = {node: node // 4 for node in range(30)}
    rows = [(sig - 4, node, comp[node], len(nodes)) for sig, nodes in held.items() for node in nodes]
    sets = spark.createDataFrame([(node, 8, bytes(128)) for node in range(30)], "node bigint, n bigint, sketch binary")
    pairs = shingle_join._cross_pairs(spark.createDataFrame(rows, "sig bigint, node bigint, comp bigint, m bigint"), sets, Fraction(4, 5))
    found = [(r.a, r.b) for r in pairs.collect()]
    meet = {p for nodes in held.values() for p in itertools.combinations(sorted(nodes), 2) if comp[p[0]] != comp[p[1]]}
    assert sorted(found) == sorted(meet)

"""Nearest pairs of a dense group, and sets of one document for each node."""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.llm import shingle_join


def _group(rng, members, size=100):
    """Variants of one set, each with a tenth of its own."""
    base = rng.integers(0, 1 << 62, size, np.int64)
    return [np.sort(np.concatenate([base[size // 20:], rng.integers(0, 1 << 62, size // 20, np.int64)])).astype(np.uint64) for _ in range(members)]


@pytest.mark.parametrize("small", [64, 3])
def test_a_dense_group_gives_a_row_for_each_node(spark, monkeypatch, small):
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    codes = _group(np.random.default_rng(3), 40)
    owner, size = np.repeat(np.arange(40), [len(c) for c in codes]), np.array([len(c) for c in codes])
    sketch = shingle_join.parity(owner, np.concatenate(codes), size)
    sets = spark.createDataFrame([(i, int(size[i]), sketch[i]) for i in range(40)], "node bigint, n bigint, sketch binary")
    rows = spark.createDataFrame([(sig, i, i, 40) for sig in range(5) for i in range(40)], "sig bigint, node bigint, comp bigint, m bigint")
    every = {(r.a, r.b) for r in shingle_join._cross_pairs(rows, sets, Fraction(4, 5)).collect()}
    got = [(r.a, r.b) for r in shingle_join._cross_pairs(rows, sets, Fraction(4, 5), nearest=True).collect()]
    apart = lambda p: shingle_join.bits_apart(sketch[p[0]], sketch[p[1]]) / (size[p[0]] + size[p[1]])
    assert len(every) > 700 and len(got) <= 39 and set(got) <= every
    if small == 3:  # whole sketches
        assert sorted(got) == [min((p for p in every if p[0] == a), key=lambda p: (apart(p), p[1])) for a in range(39)]


def test_all_pairs_are_left_for_few(spark, monkeypatch):
    """The last round meets what leaders and nearest nodes leave, not a dense group."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    base, other, texts = words(120), words(90), []
    for _ in range(60):
        own = list(base)
        own[int(rng.integers(120))] = words(1)[0]
        texts.append(" ".join(own))
    texts += [" ".join(other), " ".join([*other[:-2], *words(2)]), " ".join(words(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = {}
    cross = shingle_join._cross_pairs

    def counted(*args, nearest=False):
        got = cross(*args, nearest=nearest)
        made[nearest] = made.get(nearest, 0) + got.count()
        return got

    # Leaders that are of no use.
    monkeypatch.setattr(shingle_join, "_cross_pairs", counted)
    monkeypatch.setattr(shingle_join, "_leader_pairs", lambda rows, turn: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    got = {r.doc_id: r.component_id for r in shingle_join.classes(docs).collect()}
    assert got == {**{i: 0 for i in range(60)}, 60: 60, 61: 60, 62: 62}
    assert 0 < made[True] <= 4 * 60 and made.get(False, 0) < 60


def test_sets_are_made_of_one_document_of_each_node(spark):
    texts = ["a b c d e f g"] * 5 + ["h i j k l m n"] * 3 + ["o p q r s t u"]
    docs = spark.createDataFrame([(i - 4, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    owned = shingle_join.document_nodes(docs, 5)
    nodes = owned.where("doc_id in (-4, 1)").select("node").distinct()
    got = shingle_join.node_sets(docs, nodes, owned, 5).collect()
    assert {r.node for r in got} == {r.node for r in nodes.collect()} and all(r.n == 3 and len(r.codes) == 24 for r in got)

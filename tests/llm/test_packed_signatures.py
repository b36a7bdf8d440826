"""The shuffle of all signatures: one document of each node, and two numbers a row."""
from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from packloom.llm import shingle_join


def test_copies_in_other_tasks_give_no_rows(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 60)) for _ in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(24)], "doc_id bigint, text string").repartition(8, "doc_id")
    owned = shingle_join.document_nodes(docs, 5)
    once = shingle_join.signature_rows(docs.where("doc_id < 3").coalesce(1), 5, Fraction(4, 5))
    got = shingle_join.signature_rows(docs, 5, Fraction(4, 5), owned)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect()))
    # Rows of one doc_id with other texts are not passed over.
    more = docs.unionByName(spark.createDataFrame([(0, "one text more of this id")], docs.schema))
    nodes = shingle_join.document_nodes(more, 5)
    got = shingle_join.signature_rows(more, 5, Fraction(4, 5), nodes)
    assert {r.node for r in got.collect()} == {r.node for r in nodes.collect()}


def test_signatures_and_needs_go_as_one_number(spark):
    top = (1 << 47) - 1
    rows = [(s, n, need) for s, need in ((-top, 6), (top, 7), (5, 200_000), (6, 200_001)) for n in (1, 2)] + [(9, 1, 6)]
    made = shingle_join.buckets(spark.createDataFrame(rows, "sig bigint, node bigint, need int").repartition(3))
    want = {(-top, 6), (top, 7), (5, 65534), (6, 65535)}  # what is needed at least is never raised, and keeps its kind
    assert sorted(map(tuple, made.collect())) == sorted((s, n, need) for s, need in want for n in (1, 2))
    moved = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in moved and "key" in moved


def test_whole_classes_with_spread_copies(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = []
    for _ in range(5):
        base = words(200)
        near = list(base)
        near[100] = "other"
        texts += [" ".join(base)] * 3 + [" ".join(near)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7, F.col("doc_id"))
    got = {r.doc_id: r.component_id for r in shingle_join.classes(docs).collect()}
    assert got == {i: i - i % 6 for i in range(30)}

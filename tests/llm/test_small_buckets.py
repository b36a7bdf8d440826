"""Small buckets: only pairs that may be links leave the task, and every one of them."""
from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np

from packloom.llm import shingle_join


def _sets(spark, codes):
    size = np.array([len(c) for c in codes])
    sketch = shingle_join.parity(np.repeat(np.arange(len(codes)), size), np.concatenate(codes), size)
    return [(i, int(n), s) for i, (n, s) in enumerate(zip(size, sketch))]


def test_small_buckets_give_possible_links_only(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, (6, 700), np.int64).astype(np.uint64)
    # Ten variants of each of six sets, of different lengths; unlike sets share buckets, too.
    codes = [base[k][: int(rng.integers(560, 700))] if k < 3 else base[k][: int(rng.integers(80, 100))] for k in range(6) for _ in range(10)]
    sets = spark.createDataFrame(_sets(spark, codes), "node bigint, n bigint, sketch binary")
    held = [rng.choice(60, int(rng.integers(2, 50)), replace=False).tolist() for _ in range(200)]
    comp = [node // 3 for node in range(60)]
    rows = [(sig, node, comp[node]) for sig, nodes in enumerate(held) for node in nodes]
    small = spark.createDataFrame(rows, "sig bigint, node bigint, comp bigint").repartition(4).join(sets, "node")
    pairs = shingle_join._small_pairs(small, Fraction(4, 5)).collect()
    size = [len(c) for c in codes]
    sketch = [r.sketch for r in sorted(sets.collect(), key=lambda r: r.node)]
    want = set()
    for nodes in held:
        for a, b in itertools.combinations(sorted(nodes), 2):
            close = 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])
            if comp[a] != comp[b] and close and shingle_join.bits_apart(sketch[a], sketch[b]) * 9 <= size[a] + size[b]:
                want.add((a, b))
    assert {(r.a, r.b) for r in pairs} == want
    # Unlike sets that meet are not given out: no more rows than ten variants have among themselves, however often they meet.
    assert 0 < len(want) <= 6 * 45
    assert len(shingle_join._small_pairs(small.limit(0), Fraction(4, 5)).collect()) == 0


def test_buckets_over_batches(spark):
    """A bucket that goes on in the next Arrow batch is compared whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(sig, 10 * sig + k, 10 * sig + k, 4, bytes(128)) for sig in range(30) for k in range(5)]
        table = spark.createDataFrame(rows, "sig bigint, node bigint, comp bigint, n bigint, sketch binary")
        got = sorted((r.a, r.b) for r in shingle_join._small_pairs(table, Fraction(4, 5)).collect())
        assert got == sorted(p for sig in range(30) for p in itertools.combinations(range(10 * sig, 10 * sig + 5), 2))
        twice = [(s, n, 2) for s in range(20) for n in (s, s + 1, s + 2) for _ in range(3)]
        found = shingle_join.buckets(spark.createDataFrame(twice, "sig bigint, node bigint, need int").repartition(5)).collect()
        assert sorted(map(tuple, found)) == sorted(set(twice))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_brief_sketches_bound_the_difference(spark):
    """The shorter sketches, too, differ in at most as many bits as their sets in shingles."""
    rng = np.random.default_rng(9)
    codes = []
    for n in (1, 40, 300, 700, 3000):
        one = rng.integers(0, 1 << 62, n, np.int64).astype(np.uint64)
        other = one.copy()
        other[: n // 5] = rng.integers(0, 1 << 62, n // 5, np.int64).astype(np.uint64)
        codes += [one, other]
    sets = spark.createDataFrame(_sets(spark, codes), "node bigint, n bigint, sketch binary")
    rows = sets.mapInArrow(shingle_join._with_brief, "node bigint, n bigint, sketch binary, brief binary").collect()
    brief = {r.node: r.brief for r in rows}
    assert len(rows) == len(codes) and all(32 <= len(r.brief) <= len(r.sketch) for r in rows)
    for k in range(0, len(codes), 2):
        assert shingle_join.bits_apart(brief[k], brief[k + 1]) <= 2 * (len(codes[k]) // 5)

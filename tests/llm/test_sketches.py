"""Sketches of shingle sets, and buckets of shared signatures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.llm import mixing, shingle_join


def random_set(rng, n):
    return np.sort(rng.choice(1 << 62, n, replace=False)).astype(np.uint64)


def sketches(*sets):
    owner = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    return shingle_join.parity(owner, np.concatenate(sets), np.array([len(s) for s in sets]))


@pytest.mark.parametrize("n", [5, 600, 3000, 20_000, 60_000])
def test_sketches_bound_the_difference_and_tell_unlike_sets_apart(n):
    rng = np.random.default_rng(n)
    base = random_set(rng, n)
    for changed in (0, 1, n // 20, n // 5):
        other = np.concatenate([base[changed:], random_set(rng, changed + n // 9)])
        x, y = sketches(base, other)
        assert shingle_join.bits_apart(x, y) <= 2 * changed + n // 9
    if n > 100:
        x, y = sketches(base, random_set(rng, n + n // 5))
        assert 9 * shingle_join.bits_apart(x, y) > 2 * n + n // 5


def test_buckets_keep_what_two_nodes_share(spark):
    """Runs longer than a batch, of one node and of several; one row of a second node at the end of a long run."""
    rng = np.random.default_rng(2)
    rows = [(int(s), int(v), 2) for s, v in zip(rng.integers(-300, 300, 3000), rng.integers(0, 4, 3000))]
    rows += [(1000, 7, 2)] * 2500 + [(1001, 7, 2)] * 2500 + [(1001, 8, 3)] + [(1002 + i, 1, 2) for i in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = shingle_join.buckets(spark.createDataFrame(rows, "sig bigint, node bigint, need int").repartition(5)).distinct().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    nodes = {}
    for s, v, _ in rows:
        nodes.setdefault(s, set()).add(v)
    assert {tuple(r) for r in got} == {r for r in set(rows) if len(nodes[r[0]]) > 1}


def test_repeated_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s", i, i, i, i) for i in range(9)] + [(None, None, None, 0, 0, 0, 0)],
                                 "doc_id bigint, text string, source string, _times int, _copy int, copy int, n int")
    taken = mixing.repeated(docs, mixing.mix(docs))
    assert taken.columns == docs.columns and taken.select(F.max("copy")).first()[0] <= 8
    assert {r.doc_id for r in taken.collect()} <= {*range(9), None} and all(r._copy == r.copy == r.n for r in taken.collect())

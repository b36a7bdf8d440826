"""Substring dedup against brute force over all windows."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from packloom.llm import repeats

SCHEMA = "doc_id bigint, text string, n_words bigint, anchors string, kept_sha256 string"


def brute(rows, length):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = Counter(tuple(w[i: i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i: i + length])] > 1:
                gone[i: i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, -1, "x", "y") for d, t in rows], SCHEMA).repartition(3)


def check(spark, rows, length, seed):
    got = sorted((tuple(r) for r in repeats.dedup(frame(spark, rows), length, seed).collect()), key=str)
    assert got == brute(rows, length)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    passage, line = some(90), some(36)
    out = []
    for i in range(40):
        words = some(int(rng.integers(0, 160)))
        at = int(rng.integers(0, len(words) + 1))
        if i % 2:
            a, b = sorted(rng.integers(0, 91, 2))
            words[at:at] = passage[a:b]
        if i % 5 == 0:
            words[at:at] = line
        out.append((i, " ".join(words)))
    copy = list(passage)
    copy[45] = "other"
    return [
        *out, (50, " ".join(passage)), (51, " ".join(copy)), (52, "a " * 120), (53, "a b " * 60), (54, None), (55, ""), (56, " \n\t"),
        (57, "\t".join(passage * 2)), (58, "é日本 " * 40 + "Ünïcode <|endoftext|>"), (59, " ".join(f"v{i % 4999}" for i in range(30_000))),
        (None, " ".join(line)), (None, None), (4, out[4][1]), (4, out[4][1]), (5, "same id, other text"),
    ]


def test_repeats_equal_brute_force(spark, rows):
    got = check(spark, rows, 35, 12)
    assert sum(r[2] for r in got) > 500 and any(r[2] == 0 < r[1] for r in got)


@pytest.mark.parametrize("length,seed", [(4, 3), (6, 2), (12, 12)])
def test_repeats_of_few_kinds_of_words(spark, length, seed):
    """Two letters only: every anchor stands in many contexts, and hashes tie within a window."""
    rng = np.random.default_rng(length)
    check(spark, [(i, " ".join(rng.choice(["x", "y"], int(rng.integers(0, 60))))) for i in range(30)], length, seed)


def test_repeats_of_one_document(spark):
    words = [f"w{i}" for i in range(50)]
    assert [r[2] for r in check(spark, [(1, " ".join(words))], 35, 12)] == [0]
    assert [r[2] for r in check(spark, [(1, " ".join([*words, "x", *words[10:45]]))], 35, 12)] == [70]
    assert [r[2] for r in check(spark, [(1, " ".join([*words, "x", *words[10:44]]))], 35, 12)] == [0]


def test_repeats_of_nothing(spark):
    assert repeats.dedup(frame(spark, [])).count() == 0

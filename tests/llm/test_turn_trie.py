"""The conversation trie against brute force over all prefixes."""
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from packloom.llm import turn_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, words string, slice string"


def originals(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in own.items()}


def rebuilt(rows):
    own = originals(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(out[x][5] for x in kids[k]) or 1
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved += sum(out[x][6] for x in kids[k])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, sha)
    return sorted(out.values(), key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for c in range(90):
        for t in range(int(rng.integers(0, 20))):
            out.append((c, t * 3 - 5, ["user", "assistant", None][int(rng.integers(0, 3))], ["hi there", "", None, "a b c", "x"][int(5 * rng.random() ** 2)]))
    out += [(200, t, "user", f"long {t // 7}") for t in range(70)] + [(221, t, "user", f"long {t // 7}") for t in range(40)]
    out += [(300, None, None, None), (300, None, "user", "z"), (300, 1, "user", "one"), (None, 1, "user", "lost"), (1041, 0, "u", "t"),
            (20, 500, "user", "again"), (20, 500, "user", "again"), (400, 1 << 40, "user", "late"), (400, -(1 << 40), "user", "early")]
    return out


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie_equals_brute_force(spark, rows, block):
    assert found(turn_trie.trie(*turn_trie.rebuilt(frame(spark, rows)), block)) == brute(rebuilt(rows))


def test_slices(spark, rows, monkeypatch):
    """Positions, prefixes, sums and ids are stitched from slices of four."""
    monkeypatch.setattr(turn_trie, "SLICE_BITS", 2)
    assert found(turn_trie.trie(*turn_trie.rebuilt(frame(spark, rows)), 2)) == brute(rebuilt(rows))


def test_paths_below_paths(spark):
    """Conversation c leaves that of c - 1 one turn before its end: the tree of paths is one long path."""
    rows = [(c, t, "u", f"t{t}" if t < 38 - c else f"own {c}") for c in range(40) for t in range(40 - c)]
    turns = turn_trie.numbered(frame(spark, rows))
    lengths = turns.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    assert found(turn_trie.trie(turns, lengths)) == brute(originals(rows))


def test_trie_of_nothing(spark):
    assert turn_trie.trie(*turn_trie.rebuilt(frame(spark, []))).count() == 0
    assert turn_trie.trie(*turn_trie.rebuilt(frame(spark, [(None, 1, "u", "t")]))).count() == 0

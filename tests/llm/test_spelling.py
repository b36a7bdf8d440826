"""Spelling variants against brute force over all cuts of all words."""
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from packloom.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, form string, sig bigint"


def vocabulary(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    near = defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        if one_apart(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdeéÿ÷ñ")
    base = ["".join(rng.choice(letters, int(rng.integers(7, 12)))) for _ in range(40)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(20):
            w = list(base[int(40 * rng.random() ** 3)])
            for _ in range(int(rng.random() < 0.15) + int(rng.random() < 0.03)):
                at = int(rng.integers(0, len(w) + 1))
                w[at: at + int(rng.integers(0, 2))] = list(rng.choice(letters, int(rng.integers(0, 2))))
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, [" ", "\n", "-", "1", "日"][i % 5].join(text)))
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, None), (900, None), (901, ""), (902, "x" * 3_000),
             (903, "x" * 3_000), (904, "x" * 2_999), (905, "x" * 2_999), (906, "ABCDEFÀ abcdefà ABCDEFà ABCDEFÀ"), (907, "short ones only")]
    docs = spark.createDataFrame([(d, t, "w", 1, "f", 0) for d, t in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(spelling.vocabulary(docs)).collect())
    assert got == brute(vocabulary(rows))
    assert sum(r[1] is not None for r in got) > 20


def test_near_words_of_all_edits(spark):
    """Every edit of words at the least length, with repeated letters and anagrams about."""
    letters = "ab"
    words = ["".join(w) for n in (7, 8) for w in itertools.product(letters, repeat=n)]
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if one_apart(a, b)}


def test_chains_of_forms(spark):
    n = {"aaaaaaaa": 100_000, "aaaaaaab": 10_000, "aaaaaabb": 1000, "aaaaabbb": 100, "aaaabbbb": 10, "zzzzzzzz": 5}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()
    assert sorted(tuple(r) for r in got) == brute(n)
    assert {r["root"] for r in got} == {"aaaaaaaa", "zzzzzzzz"}


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.vocabulary(none)).count() == 0

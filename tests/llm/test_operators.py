"""The training-data operators on small tables, against brute force; odd rows in every one."""
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packloom.llm import (
    attention_lm, decontaminate, embedding_join, language, licenses, mixing, piece_counts, quality, shingle_join, token_files, words,
)
from packloom.llm.components import components, merged
from packloom.llm.elias_fano import EliasFano
from packloom.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, component_id string"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    out = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(3, 90)))]
        out.append(" ".join(base))
        for cut in (1, 3, 8):
            copy = list(base)
            for i in rng.integers(0, len(copy), cut * len(copy) // 60):
                copy[i] = word()
            out.append(" ".join(copy))
    return [*out, None, "", " \n\t", "one", "One", "a b c", "x" * 200_000, LONG, LONG, "Ünïcode é ñ 日本 <|endoftext|> don't"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with a null and a repeated row; columns whose names clash with those the operators use."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2"][i % 3], 1, -5, "x") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1", 1, -5, "x"), (None, "a row without an id " * 5, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words():
    column = pa.array(["Ab c", None, "", " ", "AB", "é\tÉ"])
    data, offsets = words.text_bytes(column)
    doc, starts, ends = words.spans(data, offsets, words.NOT_SPACE)
    raw = data.tobytes()
    assert [(int(d), raw[a:b].decode()) for d, a, b in zip(doc, starts, ends)] == [(0, "Ab"), (0, "c"), (4, "AB"), (5, "é"), (5, "É")]
    h = words.hashes(data, starts, ends)
    assert h[0] == h[2] == words.hash_word("ab") and len(set(h.tolist())) == 4


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 102), (5, 5), (7, 8)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] == got[102] != got[0]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_after_more_links(spark):
    schema = "a bigint, b bigint"
    old, new = [(1, 2), (3, 4), (5, 6)], [(2, 3), (2, 3), (5, 5), (7, 8), (8, 6), (9, 9), (None, 1)]
    got = {r.node: r.comp for r in merged(components(spark.createDataFrame(old, schema)), spark.createDataFrame(new, schema)).collect()}
    assert set(got) == set(range(1, 10))
    classes = {}
    for node, comp in got.items():
        classes.setdefault(comp, set()).add(node)
    assert sorted(map(sorted, classes.values())) == [[1, 2, 3, 4], [5, 6, 7, 8], [9]]
    assert all(comp in nodes for comp, nodes in classes.items())


def test_shingle_join(docs, none, texts):
    got = {r.doc_id: r for r in shingle_join.classes(docs).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            of[max(x, y)] = min(x, y)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}
    assert got[None].component_id is None and shingle_join.classes(docs).count() == len(texts) + 2
    assert shingle_join.classes(none).count() == 0


def test_signatures_meet():
    """Every linked pair shares a signature, at all sizes and for sets with empty parts."""
    rng, bands = np.random.default_rng(1), shingle_join.Bands(shingle_join.Fraction(4, 5))
    for n in [*range(1, 40), 80, 333, 1200]:
        for _ in range(5):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = int(rng.integers(0, n // 5 + 1))
            add = int(rng.integers(0, n // 9 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            shared = n - drop
            if not len(b) or 5 * shared < 4 * (n + len(b) - shared):
                continue
            owner = np.repeat([0, 1], [n, len(b)])
            code = np.concatenate([np.sort(a), np.sort(b)])
            doc, sig, need = shingle_join.signatures(owner, code, np.array([n, len(b)]), bands)
            assert set(sig[doc == 0]) & set(sig[doc == 1]), (n, drop, add)


def test_embedding_join(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=24) * 0.16
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 11 else None))
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [1.0, None], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embedding_join.near_copies(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([-1 - i if r[2] is None else r[2] for i, r in enumerate(rows)])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(400)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum() > 0
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept and not got[None].kept


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)]
    item = lambda n: [vocabulary[i] for i in rng.integers(0, 300, n)]
    items = [item(n) for n in (3, 5, 9, 30, 59, 250)]
    rows = []
    for k, it in enumerate(items):
        text = item(70) + it + item(20)
        rows.append((k, " ".join(text).upper()))
        changed = list(it)
        if len(it) > 20:
            changed[len(it) // 2] = "other"
        rows.append((10 + k, "  ".join(item(5) + changed)))
        rows.append((20 + k, " ".join(item(9) + it[: len(it) // 2])))
    rows += [(90, None), (91, ""), (None, " ".join(items[3])), (92, " ".join(items[3][:-1])), (0, rows[0][1])]
    table = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(table, bench).collect()}
    bag = lambda w: [tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))]
    expected = {}
    for d, t in rows:
        w = split(t)
        for i, it in enumerate(items):
            b, best = bag(it), 0.0
            for s in range(max(1, len(w) - len(it) + 1)) if w else ():
                a = bag(w[s: s + len(it)])
                shared = sum(min(a.count(v), b.count(v)) for v in set(a))
                best = max(best, shared / (len(a) + len(b) - shared))
            if best >= 0.8:
                expected[d, i] = best
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    kept = [r.doc_id for r in decontaminate.clean(table, bench).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(d for d, _ in rows if d is not None and d not in {k[0] for k in expected})
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_licenses(spark, none):
    rows = [(0, "x. Released under the MIT\nLicense. apache-license"), (1, None), (2, ""), (3, "mit licensed"), (4, "all rights reserved"),
            (5, LONG + " Licensed under the Apache License, Version 2.0."), (6, "rights all the way, nothing reserved"), (None, "mit license mit license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0][1:] == (8, 2, 4, 6, "apache,mit", "apache,mit", 1.0)
    assert got[1][1:] == got[2][1:] == (0, 0, None, None, "", "", 0.0)
    assert got[3].n_base == 0 and got[4].labels == "all-rights-reserved" and got[4].base_labels == ""
    assert (got[5].n_base, got[5].first_word, got[5].labels) == (1, 60_003, "apache") and got[None].n_base == 2
    assert licenses.scan(none).count() == 0


def test_license_blocks_against_all_windows():
    """A template that stands within any 2 m-word block at the threshold is found."""
    rng = np.random.default_rng(4)
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    matcher = licenses.Matcher({template: "t"}, {}, 0.8, dict.fromkeys(template.split(), 1))
    for _ in range(60):
        keep = [w for w in template.split() if rng.random() < 0.85]
        text = " ".join(["pad"] * int(rng.integers(0, 40)) + keep + ["pad"] * int(rng.integers(0, 40)))
        data, offsets = words.text_bytes(pa.array([text]))
        assert (matcher.run(data, offsets)[0][5] == {"t"}) == (len(keep) >= 8)


def test_language(spark, tables, docs, none):
    real = spark.read.parquet(f"{tables}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    chain = language.train(real, fold != 2)
    rows = language.identify(real, chain).join(real.select("doc_id", "lang"), "doc_id").where(fold == 2).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = {r.doc_id: r for r in language.identify(spark.createDataFrame([(0, None), (1, ""), (2, "12 34 !"), (3, "é")], "doc_id bigint, text string"), chain).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred in chain.names
    assert language.identify(docs, chain).count() == docs.count() and language.identify(none, None).count() == 0
    assert language.train(none, F.lit(True)) is None
    assert {r.lang for r in language.word_labels(real.limit(5), chain).collect()} <= set(chain.names)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(5)
    chain = language.Chain(["a", "b", "c"])
    chain.moves = rng.normal(size=(3, 3))
    emit = rng.normal(size=(6, 3))
    p = chain.marginals(emit, np.array([0, 4]), np.array([4, 2]))
    for first, n in ((0, 4), (4, 2)):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(emit[first + i, y] for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(p[first: first + n], want / want.sum(1, keepdims=True))


def test_quality(spark, tables, docs, none):
    real, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet").selectExpr("doc_id", "quality label")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    network = quality.train(real, labels, fold != 1)
    rows = quality.score(real, network).join(labels, "doc_id").where(fold == 1).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in rows) >= 0.85 * len(rows)
    assert quality.score(docs, network).where("score between 0 and 1").count() == docs.count()
    assert quality.filtered(docs, network).columns == docs.columns
    assert quality.train(none, labels, F.lit(True)) is None and [r.score for r in quality.score(docs.limit(1), None).collect()] == [0.5]


def test_quality_network_against_plain_loops():
    network, rng = quality.Network(), np.random.default_rng(6)
    for n in (0, 1, 3, 127, 128, 129, 300, 1000):
        text = rng.integers(1, 256, n).astype(np.uint8)
        padded = np.concatenate([text, np.zeros(quality.WIDTH, np.uint8)])
        act = np.array([sum(network.p["t"][k][padded[i + k]] for k in range(quality.WIDTH)) for i in range(max(1, n))])
        z = []
        for c in range(max(1, -(-n // quality.STRIDE) - 1)):
            z.append(network.head(np.maximum(act[c * quality.STRIDE: (c + 2) * quality.STRIDE].max(0) + network.p["b"], 0)[None])[1][0])
        assert np.isclose(network.scores(text, np.array([0, n]))[0], 1 / (1 + np.exp(-np.mean(z))), atol=1e-5)
    long = rng.integers(1, 256, 3 << 20).astype(np.uint8)
    total, chunks = network._logits(long, np.array([len(long)]))
    assert np.isclose(network._long(long), total[0] / chunks[0], atol=1e-4)


def test_attention(spark, docs, none):
    out = attention_lm.score(docs, F.col("doc_id") % 7 != 2, PATH).collect()
    assert len(out) == docs.count() and all(r.score < 0 and r.n_tokens >= 1 for r in out)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = {}
    for d, t in rows:
        if d is None or d % 7 != 2:
            for w in [*split(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, len(split(t)) + 1, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*split(t), None])) for d, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.base_score) for r in out)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert attention_lm.score(none, F.lit(True), PATH).count() == 0


def test_attention_is_a_distribution_and_causal():
    classes = np.arange(40) % 5
    model = attention_lm.AttentionModel(classes)
    model.learn_counts(np.arange(40.0), np.ones((attention_lm.CLASSES, attention_lm.CLASSES)))
    ids = np.random.default_rng(7).integers(0, 39, 100)
    source, target, _ = attention_lm.blocks(ids, np.array([100]), 39)
    assert (target >= 0).sum() == 101
    model.class_of = np.concatenate([classes, np.arange(5, attention_lm.CLASSES)])  # every class has an id
    total = sum(np.exp(model.log_probabilities(source[1:2], np.full((1, attention_lm.STRIDE), i))[0, 5]) for i in range(40))
    rest = 1 - np.exp(model._forward(source[1:2])["logits"])[0, 5][:5].sum() / np.exp(model._forward(source[1:2])["logits"])[0, 5].sum()
    assert np.isclose(total + rest, 1, atol=1e-4)
    changed = ids.copy()
    changed[60:] = 1
    again, _, _ = attention_lm.blocks(changed, np.array([100]), 39)
    a, b = model.log_probabilities(source, target), model.log_probabilities(again, target)
    assert np.allclose(a.ravel()[:61], b.ravel()[:61], atol=1e-5)


def test_attention_with_runs_is_a_distribution():
    rng, n_ids = np.random.default_rng(21), 70
    inner = np.arange(n_ids) % 3 == 0
    inner[-1] = False
    model = attention_lm.AttentionModel(np.arange(n_ids) % attention_lm.CLASSES, inner)
    text = rng.integers(0, 9, 300)
    ended = np.concatenate([[n_ids - 1], text, [n_ids - 1]])
    ids = np.bincount(ended[1:], minlength=n_ids)
    model.learn_counts(ids, np.ones((attention_lm.CLASSES, attention_lm.CLASSES)))
    source, target, _ = attention_lm.blocks(text, np.array([300]), n_ids - 1)
    plain = model.log_probabilities(source, target)
    keys, n = np.unique(attention_lm.run_keys(ended, inner), return_counts=True)
    assert (keys >= n_ids ** 2).any()
    for some in (n > 0, n > 2, n > 10**6):
        model.learn_runs(ids.astype(float), keys[some], n[some])
        for place in (0, 5, 31):
            p = np.exp([model.log_probabilities(source[1:2], np.full((1, attention_lm.STRIDE), i))[0, place] for i in range(n_ids)])
            assert np.isclose(p.sum(), 1, atol=1e-4)
        if not some.any():
            assert np.allclose(plain, model.log_probabilities(source, target))


def test_attention_counts_runs_of_all_texts(spark, monkeypatch):
    rng, n_ids, counts = np.random.default_rng(4), 40, {}
    inner = np.arange(n_ids) < 5
    texts = [rng.integers(0, n_ids - 1, n) for n in (0, 1, 31, 500, 900, 900)]
    for t in texts:
        e = [n_ids - 1, *t.tolist(), n_ids - 1]
        found = [a * n_ids + b for a, b in zip(e, e[1:])] + [
            n_ids ** 2 + (a * n_ids + b) * n_ids + c for a, b, c in zip(e, e[1:], e[2:]) if b < 5]
        for key in found:
            counts[key] = counts.get(key, 0) + 1
    table = spark.createDataFrame([(i, bytearray(t.astype("<u2").tobytes())) for i, t in enumerate(texts)], "salt bigint, ids binary").repartition(3)
    assert dict(zip(*map(np.ndarray.tolist, attention_lm.following(table, inner)))) == counts
    monkeypatch.setattr(attention_lm, "FOLLOWERS", 200)
    some = dict(zip(*map(np.ndarray.tolist, attention_lm.following(table, inner))))
    assert 0 < len(some) <= 200 and some == {k: v for k, v in counts.items() if v >= min(some.values())}
    assert [len(x) for x in attention_lm.following(table.limit(0), inner)] == [0, 0]


def test_attention_tells_many_texts_of_one_id_apart(spark):
    """Of 1,500 different texts without an id, some agree in 16 bits of their hash."""
    table = spark.createDataFrame([(None, "one " * (i + 1)) for i in range(1500)], "doc_id bigint, text string")
    rows = attention_lm._rows(table, F.lit(True))
    got = attention_lm.base_scores(rows, attention_lm._encoded_table(rows, PATH, WordEncoder(PATH).n_ids + 1)).collect()
    assert sorted(r.n_tokens for r in got) == list(range(2, 1502))


def test_attention_learns_from_all_training_rows(spark):
    """Ids seen three times anywhere get a class of their neighbours, beyond any 1500 texts."""
    encoder = WordEncoder(PATH)
    names = sorted(t.removesuffix("</w>") for t in encoder.tok.get_vocab() if re.fullmatch("[a-z]{4,9}</w>", t))[:600]
    table = spark.createDataFrame([(i, f"{names[i % 600]} {names[i // 600]}") for i in range(1800)], "doc_id bigint, text string")
    model, encoded = attention_lm.train(attention_lm._rows(table, F.lit(True)), PATH)
    ids = np.concatenate([encoder.whole(n) for n in names])
    assert (model.class_of[ids] < attention_lm.CLASSES - 1).all() and (model.class_of == attention_lm.CLASSES - 1).any()
    assert encoded.where("kind = 0 and learn").count() == 1800


def test_attention_blocks_each_fitted_once():
    rng, n_ids, count = np.random.default_rng(12), 40, [0, 31, 32, 5000, 7]
    texts = [rng.integers(0, n_ids - 1, n) for n in count]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([-3, 2, 9, 4, 70_000]), pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())], names=["salt", "ids"])
    source, target, _ = attention_lm.blocks(np.concatenate(texts), np.array(count), n_ids - 1)
    want, got, seen = [x.tobytes() + y.tobytes() for x, y in zip(source, target)], [], [0]
    for turn in range(attention_lm.ROUNDS):
        for x, y in attention_lm._batches(iter([batch]), n_ids, turn, 2, seen):
            got += [a.tobytes() + b.tobytes() for a, b in zip(x, y)]
    assert seen == [len(want)] and sorted(got) == sorted(want * 2)


def test_piece_counts(docs, none, texts):
    vocabulary = set(piece_counts.vocabulary(PATH))
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = 0
        while word:
            word = word[max(j for j in range(1, min(len(word), longest) + 1) if word[:j] in vocabulary):]
            n += 1
        return n

    got = {r.doc_id: r for r in piece_counts.piece_counts(docs, PATH).collect()}
    for i, t in enumerate(texts):
        if i != texts.index("x" * 200_000):
            assert (got[i].n_words, got[i].n_tokens) == (len(split(t)), sum(greedy(w.encode()) for w in split(t)))
    assert piece_counts.piece_counts(none, PATH).count() == 0


def test_automaton_unknown_words():
    auto = piece_counts.Automaton([b"a", b"ab", b"abc", b"bcd", b"d"])
    data = np.frombuffer(b"abcd ab abd cd abcbcd", np.uint8)
    _, starts, ends = words.spans(data, np.array([0, len(data)]), words.NOT_SPACE)
    assert auto.counts(data, starts, ends).tolist() == [2, 1, 2, 1, 2]


def test_mixing(docs, none, texts):
    out = mixing.mix(docs, block=16).collect()
    assert len(out) == docs.count() and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs, block=16).collect()), key=str)
    sizes = {i: len(split(t)) for i, t in enumerate(texts)} | {None: 25}
    assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in out)
    source = {}
    for r in out:
        source.setdefault((r.source_size, r.target), []).append((r.taken, r["size"]))
    assert sum(t for _, t in source) == pytest.approx(1.5 * sum(s for s, _ in source)) and all(t <= 2 * s for s, t in source)
    # No draw of whole documents can come nearer than half of one that holds most of its source.
    assert all(abs(sum(x for x, _ in v) - t) <= 100 + max(n for _, n in v) / 2 for (_, t), v in source.items())
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(docs, mixing.mix(docs)).columns == docs.columns


def test_elias_fano():
    rng = np.random.default_rng(8)
    for n, top in ((1, 0), (1, 5), (3, 1000), (1000, 1000), (5000, 40), (700, 1 << 20)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = EliasFano.build(values, top)
        again = EliasFano(n, top, *code.parts())
        assert (again.all() == values).all() and [again.select(i) for i in range(0, n, 7)] == values[::7].tolist()


def test_token_files(spark, docs, none, tmp_path):
    tok = WordEncoder(PATH).tok
    token_files.write(docs, f"{tmp_path}/a", PATH, 1, segment=500)
    got = sorted(token_files.read(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    ids = [i for i in (r.doc_id for r in got) if i is not None]
    assert ids == sorted(ids) and len(got) == docs.count() and got[0].doc_id is None
    start = 0
    for r in got:
        want = tok.encode(texts[r.doc_id][0], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    row = token_files.open_segments(spark, f"{tmp_path}/a").where("n_docs > 2").first()
    assert len(token_files.document(row, 2)) > 0
    token_files.write(none, f"{tmp_path}/b", PATH, 1)
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, tables)
        assert rows.dtypes == docs.dtypes
        docs = spark.createDataFrame(rows.collect(), docs.schema)
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == docs.count()

"""op7 does each thing once: gradients of joined weights, sorted look-ups, and base scores whose frequent words stay out of the join."""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from packloom.llm import attention_lm

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_gradient_is_that_of_the_mean_loss():
    rng, n_ids = np.random.default_rng(6), 90
    model = attention_lm.AttentionModel(rng.integers(0, attention_lm.CLASSES, n_ids))
    model.learn_counts(np.ones(n_ids), rng.integers(1, 9, (attention_lm.CLASSES, attention_lm.CLASSES)))
    model.p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in model.p.items()}
    source, target, _ = attention_lm.blocks(rng.integers(0, n_ids - 1, 150), np.array([70, 0, 80]), n_ids - 1)

    def loss():
        logits = model._forward(source)["logits"].astype(np.float64)
        log_p = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        goal = model.class_of[np.maximum(target, 0)]
        return -np.take_along_axis(log_p, goal[:, :, None], 2)[:, :, 0][target >= 0].mean()

    got = model._gradient(source, target)
    for name, v in model.p.items():
        size = np.linalg.norm(got[name])
        way = got[name] / size
        kept, step = v.copy(), np.float32(5e-3)
        model.p[name] = kept + step * way
        up = loss()
        model.p[name] = kept - step * way
        slope = (up - loss()) / (2 * float(step))
        model.p[name] = kept
        assert np.isclose(size, slope, rtol=0.03, atol=2e-5), name


def test_sorted_look_ups():
    rng = np.random.default_rng(2)
    for top in (50, 1 << 40, 1 << 61):
        keys = np.unique(rng.integers(0, top, 300))
        wanted = np.concatenate([rng.choice(keys, 400), rng.integers(0, top, 400)])
        at = {k: i for i, k in enumerate(keys.tolist())}
        assert attention_lm._places(keys, wanted).tolist() == [at.get(w, -1) for w in wanted.tolist()]
        assert attention_lm._places(keys, wanted[:0]).tolist() == [] and set(attention_lm._places(keys[:0], wanted)) == {-1}
    held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [rng.integers(0, 200, s) for s in (0, 30, 1, 500)]
    for part in parts:
        held, n = attention_lm._added(held, n, [part])
    assert [x.tolist() for x in (held, n)] == [x.tolist() for x in np.unique(np.concatenate(parts), return_counts=True)]


@pytest.mark.parametrize("held", [0, 8, 1 << 20])
def test_base_scores_with_few_held_words(spark, monkeypatch, held):
    rng = np.random.default_rng(12)
    names = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 60)), p=np.arange(40, 0, -1) / 820))) for i in range(50)] + [(None, None), (3, "w1 q"), (3, "w1 q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    table = attention_lm._rows(docs, F.col("doc_id") % 7 != 2)
    monkeypatch.setattr(attention_lm, "HELD_WORDS", held)
    encoded = attention_lm._encoded_table(table, PATH, 49_407)
    count, total = {}, 0
    for i, text in rows:
        for w in [*(text or "").split(), None] if i is None or i % 7 != 2 else []:
            count[w], total = count.get(w, 0) + 1, total + 1
    want = set()
    for i, text in rows:
        c = [count.get(w, 0) for w in [*(text or "").split(), None]]
        want.add((-1 if i is None else i, len(c), sum(x > 0 for x in c), total, round(float(sum(np.log10((x + 1) / (total + len(count) + 1)) for x in c)), 6)))
    got = attention_lm.base_scores(table, encoded).collect()
    assert {(-1 if r.id == attention_lm._NO_ID else r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == want
    assert len(got) == len(set(rows))


def test_held_words_make_no_rows(spark):
    from packloom.llm import words as W

    table = attention_lm._rows(spark.createDataFrame([(1, "a b a c"), (2, "")], "doc_id bigint, text string"), F.lit(True))
    word = np.sort(np.array([W.hash_word("a"), attention_lm.END_WORD & (2 ** 64 - 1)], np.uint64).view(np.int64))
    got = attention_lm.word_uses(table, word, np.array([3, 3]), True).collect()
    assert sorted((r.id, r.n, r.k) for r in got if r.word is None) == [(1, 5, 3), (2, 1, 1)]
    assert sorted(np.int64(r.word).view(np.uint64) for r in got if r.word is not None) == sorted(W.hash_word(w) for w in "bc")

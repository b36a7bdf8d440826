"""Runs of ids beyond those that every scoring task holds."""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from packloom.llm import attention_lm

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("held", [0, 60])
def test_runs_that_are_not_held_count_as_those_that_are(spark, monkeypatch, held):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 40))))) for i in range(60)] + [(None, None), (3, "abc"), (3, "abc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    monkeypatch.setattr(attention_lm, "DRAWS", 500)

    def scores():
        return sorted((r.doc_id or -1, r.n_tokens, r.score) for r in attention_lm.score(docs, F.col("doc_id") % 7 != 2, PATH).collect())

    whole = scores()
    monkeypatch.setattr(attention_lm, "FOLLOWERS", held)
    some = scores()
    assert [r[:2] for r in some] == [r[:2] for r in whole]
    assert np.allclose([r[2] for r in some], [r[2] for r in whole], rtol=1e-9)

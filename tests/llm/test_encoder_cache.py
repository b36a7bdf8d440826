"""The cache of words is emptied when it is full, with the same ids."""
from __future__ import annotations

import numpy as np
import public_tokenizers

from packloom.llm import encoder
from packloom.llm.queries import WORD_BPE


def test_full_cache(monkeypatch):
    assert encoder._KEPT <= 1_000_000  # about 160 MB a worker, of which an executor holds several
    rng = np.random.default_rng(2)
    texts = [" ".join(f"wort{x}" for x in rng.integers(0, 400, 60)).encode() for _ in range(20)]
    want = encoder.WordEncoder(public_tokenizers.path(WORD_BPE))
    some = encoder.WordEncoder(public_tokenizers.path(WORD_BPE))
    run = lambda e, t: e.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()
    whole = [run(want, t) for t in texts]
    monkeypatch.setattr(encoder, "_KEPT", 100)
    for t, ids in zip(texts, whole):
        assert run(some, t) == ids == want.whole(t.decode()).tolist()
        assert len(some.keys) <= 100

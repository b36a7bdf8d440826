"""Windows at the least similarity are found though their fingerprints differ much."""
import numpy as np

from packloom.llm import decontaminate


def test_windows_at_the_least_similarity(spark):
    rng = np.random.default_rng(13)
    items = [[f"v{x}" for x in rng.integers(0, 100_000, 40)] for _ in range(400)]
    bench = spark.createDataFrame([(i, " ".join(it)) for i, it in enumerate(items)], "item_id bigint, text string")
    # 32 of 36 shingles are shared: 32 / 40 = 0.8
    docs = spark.createDataFrame([(i, " ".join(it[:36] + ["x1", "x2", "x3", "x4"])) for i, it in enumerate(items)], "doc_id bigint, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(400)]
    assert max(r.hamming for r in got) > 15

"""Batches of texts that go to Python workers."""
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from packloom import session
from packloom.llm import quality

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_bound_batches_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "BATCH_BYTES", 100_000)
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    most = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it)
    try:
        assert docs.mapInArrow(most, "n bigint").agg(F.max("n")).first()[0] > 1_000_000
        corpus_pipeline.mixed(spark, docs.withColumn("source", F.lit("s")), "")
        assert docs.mapInArrow(most, "n bigint").agg(F.max("n")).first()[0] < 200_000
        spark.conf.set(KEY, "50000")
        session.small_batches(spark)
        assert spark.conf.get(KEY) == "50000"
    finally:
        spark.conf.unset(KEY)


def test_scores_of_a_filter_need_no_pandas(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (None, "", "z")], "doc_id bigint, text string, lang string")
    network = quality.Network()
    by_id = {r.doc_id: r.score for r in quality.score(docs, network).collect()}
    kept = quality.filtered(docs, network, 0.0)
    assert kept.columns == docs.columns and kept.count() == 3
    assert {r.doc_id for r in quality.filtered(docs, network, 0.5).collect()} == {k for k, v in by_id.items() if v >= 0.5}
    assert "ArrowEvalPython" in kept._jdf.queryExecution().toString() and quality.filtered(docs, None).count() == 3

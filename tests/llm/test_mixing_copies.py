"""Copies of one row are dealt over blocks."""
from pyspark.sql import functions as F

from packloom.llm import mixing


def test_copies_spread_over_blocks(spark, monkeypatch):
    flight = mixing._flight

    def watched(seed, land):
        run = flight(seed, land)

        def of(pdf):
            if len(pdf) > 400:
                raise ValueError(f"{len(pdf)} rows in one block")
            return run(pdf)

        return of

    monkeypatch.setattr(mixing, "_flight", watched)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")))
    once, again = ([tuple(r) for r in mixing.mix(docs, block=128).collect()] for _ in range(2))
    assert len(once) == 6000 and sorted(once, key=str) == sorted(again, key=str)


def test_numbered(spark):
    rows = [(1, "s", 5)] * 5000 + [(None, None, 0)] * 3 + [(2, "s", 1)]
    got = mixing.numbered(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "s", 5, i) for i in range(5000)] + [(None, None, 0, i) for i in range(3)] + [(2, "s", 1, 0)], key=str)

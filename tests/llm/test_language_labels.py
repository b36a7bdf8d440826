"""A label rarer than the sample can show is learned."""
from pyspark.sql import functions as F

from packloom.llm import language


def test_rare_label_is_learned(spark):
    last = [r.id for r in spark.range(600).orderBy(F.xxhash64("id", F.lit(5)).desc()).limit(2).collect()]
    rows = [(i, "zzyzx qoqo wuwu kiki " * 5 if i in last else "the cat sat on a mat " * 5, "rare" if i in last else "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    chain = language.train(docs, F.lit(True), sample=50)
    assert chain.names == ["en", "rare"]
    assert {r.doc_id for r in language.identify(docs, chain).where("lang_pred = 'rare'").collect()} == set(last)

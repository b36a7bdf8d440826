"""Spelling variants: words one code point apart, found by PartEnum signatures over their letter multisets.

Candidates. The multiset of a word's letters is a binary vector over (letter, occurrence); one inserted, deleted or
replaced code point changes at most two of its dimensions. The dimensions fall into ``PARTS`` parts by hash, and a
signature is what a word has in all but two of them: near words agree on at least one such choice. Each signature is
given out twice, with the first and with the last code points of the word: with least length m, two near words share
their first m // 2 code points or their last m - m // 2. So every near pair has a signature in common and buckets stay
small; pairs of a bucket are verified by edit distance, and only near pairs leave the join.

Words. Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, counted over whole texts. Where 31
divides h, the crc32 of "<doc_id>:<run>", code point h % length of the run is taken out. A null doc_id is the empty
string there, a null or empty text has no words, repeated rows count each, an empty table has no vocabulary. Columns other
than doc_id and text are not read.

Every word has one form at most, at least ``FACTOR`` times as frequent, so chains of forms end after a few steps.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.session import materialize

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
PARTS, CHANGED = 4, 2
_U = np.uint64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNED = "sig bigint, word string"


def vocabulary(docs: DataFrame, every: int = 31, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur at least ``min_count`` times."""
    runs = docs.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("prefix"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("run"),
    ).select("prefix", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat("prefix", "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    found = runs.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_signatures(words: list[str], min_length: int = MIN_LENGTH, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, signature) of all signatures."""
    length = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), length)
    first = np.cumsum(length) - length
    ends = []
    for lo, n in ((first, min_length // 2), (first + length - (min_length - min_length // 2), min_length - min_length // 2)):
        h = np.full(len(words), n, _U)
        for j in range(n):
            h = W.mix(h ^ code[lo + j].astype(_U))
        ends.append(h)
    order = np.lexsort((code, word))
    code = code[order]
    at = np.arange(len(code))
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (word[1:] != word[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    h = W.mix((code.astype(_U) << _U(32)) + nth.astype(_U) + _U(0x9E3779B97F4A7C15))
    sums = np.zeros((len(words), parts), _U)
    np.add.at(sums, (word, (h >> _U(40)).astype(np.int64) % parts), h)
    out = []
    for i, kept in enumerate(itertools.combinations(range(parts), parts - CHANGED)):
        rest = np.full(len(words), i, _U)
        for p in kept:
            rest = W.mix(rest + sums[:, p])
        out += [W.mix(rest ^ end) for end in ends]
    return np.tile(np.arange(len(words)), len(out)), np.concatenate(out).view(np.int64)


def _signed(min_length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            if len(column):
                at, sig = letter_signatures(column.to_pylist(), min_length, parts)
                yield pa.RecordBatch.from_arrays([pa.array(sig), column.take(pa.array(at))], ["sig", "word"])

    return run


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, parts: int = PARTS) -> DataFrame:
    """(a, b), a < b: the words of ``words`` (word, distinct, each of ``min_length`` code points at least) that differ by
    one inserted, deleted or replaced code point."""
    signed = materialize(words.select("word").mapInArrow(_signed(min_length, parts), _SIGNED), "signatures")
    a, b = (signed.select("sig", F.col("word").alias(c)) for c in ("a", "b"))
    return a.join(b, "sig").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: forms are followed twice as far each round."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def variants(words: DataFrame, factor: int = FACTOR, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    words = materialize(words.select("word", "n"), "vocabulary")
    pairs = materialize(near_words(words, min_length), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best: Column = F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("form")))
    near = both.join(words.withColumnRenamed("word", "b"), "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near.withColumnRenamed("a", "word"), "word", "left").withColumn(
        "best", F.when(-F.col("best.n") >= F.col("n") * factor, F.col("best")))
    near = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    return near.join(_roots(near.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

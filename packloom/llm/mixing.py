"""Mixing sources to target weights by balanced sampling (cube method).

A target of 2.3 times a document's share is met by two whole copies and an inclusion probability of 0.3.
The flight phase moves the vector of probabilities through the null space of the two constraints, documents
and words, until at most eight per block are fractional; leftovers of many blocks meet in fewer, larger
blocks until one per source is left, where landing takes the rounding nearest to the words due.

Sources are ordered by code point, null last. A null text has size 0. Empty tables give empty ones;
repeated rows are sampled each for itself. A source of size 0 has target 0 and takes nothing.
Columns of the input other than doc_id, text, source are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.session import materialize

BLOCK = 2048
HELD, LANDED = 6, 14
_EDGE = 1e-9


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            sizes = [np.zeros(0, np.int64)]
            for lo, hi in W.slices(offsets):
                doc, _, _ = W.spans(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], W.NOT_SPACE)
                sizes.append(np.bincount(doc, minlength=hi - lo))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(sizes), pa.int64())], names=["doc_id", "source", "size"])

    chosen = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "text")
    return chosen.mapInArrow(run, "doc_id bigint, source string, size bigint")


def targets(sized: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """One row per source: source_size, target. Water is filled at equal level per weight, each source up to
    ``limit`` times its size, until ``share`` of all sizes is dealt out."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = totals.select("*", weight.alias("weight"), (F.lit(float(limit)) * F.col("source_size")).alias("most"))
    everything = Window.partitionBy(F.lit(0))
    by_fill = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_fill), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
    # The first source, in order of filling, that the level leaves unfilled sets the level of all after it.
    open_level = F.when(level <= F.col("most") / F.col("weight"), level)
    final = F.first(open_level, ignorenulls=True).over(everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()))
    return ranked.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("weight") * final, "most"), F.col("most")).alias("target"))


def _fly(p: list[float], x: list[float], draw: Callable[[], float]) -> list[float]:
    """Flight with the two constraints sum(p) and sum(p * x); at most two stay fractional."""
    active, i, n = [], 0, len(p)
    while True:
        while len(active) < 3 and i < n:
            if _EDGE < p[i] < 1 - _EDGE:
                active.append(i)
            i += 1
        if len(active) < 3:
            return p
        a, b, c = active
        v = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / s if s > 0 else -p[k] / s for k, s in zip(active, v) if s)
        down = min(p[k] / s if s > 0 else (p[k] - 1) / s for k, s in zip(active, v) if s)
        step = up if draw() * (up + down) < down else -down
        for k, s in zip(active, v):
            q = p[k] + step * s
            p[k] = 0.0 if q < _EDGE else 1.0 if q > 1 - _EDGE else q
        active = [k for k in active if 0 < p[k] < 1]


def _land(p: list[float], x: list[float]) -> list[float]:
    """Rounds the few fractional ones: of all roundings, the one whose words and documents come nearest
    to what is due."""
    loose = [i for i, q in enumerate(p) if 0 < q < 1]
    masks = np.arange(1 << len(loose))
    words = docs = np.zeros(len(masks))
    for j, i in enumerate(loose):
        words, docs = words + (masks >> j & 1) * x[i], docs + (masks >> j & 1)
    off = np.abs(words - sum(p[i] * x[i] for i in loose)) + np.abs(docs - sum(p[i] for i in loose))
    best = int(np.argmin(off))
    for j, i in enumerate(loose):
        p[i] = float(best >> j & 1)
    return p


def _block(pdf: pd.DataFrame, seed: int, land: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["salt", "doc_id", "size"], kind="stable").reset_index(drop=True)
    rng = np.random.Generator(np.random.PCG64([seed, len(pdf), int(pdf["size"].sum())]))
    p, x = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
    held = max(0, len(p) - (LANDED if land else HELD))  # a few of all sizes stay loose, to land on
    p = _fly(p[:held], x[:held], rng.random) + p[held:]
    return pdf.assign(p=_land(p, x) if land else p)


def _flight(seed: int, land: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _block(pdf.drop(columns="piece"), seed, land)


def numbered(sized: DataFrame) -> DataFrame:
    """The same rows with ``copy``, which numbers equal ones. Counted first and listed in slices, so no task gets all copies of a row."""
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    slices = counted.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK)))).repartition("doc_id", "source", "size", "slice")
    first = F.col("slice") * BLOCK
    return slices.select("doc_id", "source", "size", F.explode(F.sequence(first, F.least(first + BLOCK, "n") - 1)).alias("copy"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken. Texts are read once; the rest is one small row a document."""
    sized = materialize(word_sizes(docs), "sizes")
    goal = materialize(targets(sized, weights, share, limit), "targets")
    key = (F.coalesce("source", F.lit("")), F.col("source").isNull())
    dealt = numbered(sized).select("*", key[0].alias("k0"), key[1].alias("k1")).join(
        goal.select(key[0].alias("k0"), key[1].alias("k1"), "source_size", "target", "n_docs"), ["k0", "k1"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A ratio within rounding of a whole number is that number.
    near = F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio)
    salt = F.xxhash64("doc_id", "size", F.lit(seed))
    state = dealt.select(
        "doc_id", "size", "k0", "k1", "source_size", "target", "n_docs", F.floor(near).cast("bigint").alias("whole"),
        (near - F.floor(near)).alias("p"), F.when(F.col("copy") == 0, salt).otherwise(F.xxhash64(salt, "copy")).alias("salt"))
    columns = "doc_id bigint, size bigint, k0 string, k1 boolean, source_size bigint, target double, n_docs bigint, whole bigint, p double, salt bigint"
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    done, n, left = [], 0, state
    while True:
        last = most <= block
        # The number of blocks of a source follows its number of loose documents.
        blocks = F.ceil(F.col("n_docs") / F.pow(F.lit(block / 8.0), n) / block)
        piece = F.pmod(F.xxhash64("salt", F.lit(n)), F.greatest(blocks, F.lit(1)))
        flown = materialize(
            left.withColumn("piece", piece).groupBy("k0", "k1", "piece").applyInPandas(_flight(seed + n, last), columns), "flight")
        loose = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~loose))
        if last:
            break
        left, n, most = flown.where(loose), n + 1, -(-most * 8 // block)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("p").cast("bigint")) * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. Empty documents, which cost no
    words, stay once, and so do rows with a null doc_id. Rows that share a doc_id are each taken as often as the most drawn of them."""
    copy = "copy"
    while copy in (c.lower() for c in docs.columns):
        copy += "_"
    times = mixed.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)).alias("n"))
    n = F.coalesce(times["n"], F.lit(1))
    joined = docs.join(times, docs["doc_id"] == times["doc_id"], "left")
    return joined.where(n > 0).select(
        *(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), n)).alias(copy)).drop(copy)

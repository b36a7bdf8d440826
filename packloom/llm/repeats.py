"""Substring dedup: repeated word sequences by seed and extend.

A window is ``length`` consecutive words ([^\\x20\\x09-\\x0D]+, unchanged) of one text; a word is removed if a window that
covers it stands anywhere else as well, in the same text or another. Windows are judged on the input.

Seeds. Winnowing: a window's anchor is the smallest hash among its sequences of ``SEED`` words, the last of these if there
are several. Equal windows have the same anchor at the same place. Neighbouring windows mostly share their anchor, so a text has
about two anchors for each length - SEED + 2 words; each stands for a run of windows, and its context is the hash of all
words these cover.

Extension. Texts are joined on their anchors without pairs of places. An anchor that stands once covers no repeat. One
that always stands in the same context extends over the whole of it, to both sides, wherever it stands. Where contexts
differ, equal ones are one class; a class of several places extends over its whole context, too. For a class of one place it is
found how far it extends together with the other classes of its anchor: each class gives the windows of its run,
left words and right words at once, and equal windows are counted by hash. Adjoining windows that repeat make up the
maximal repeats.

A hot anchor is thus counted in partial sums, and its classes spread over the hashes of their windows. Words, anchors
and contexts are hashed to 64 bits; two windows count as equal when anchor and window hash both agree.

Rows are told apart by doc_id and a hash of the text, so repeated rows, and null ids, are texts of their own that repeat each
other. A null text has no words. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.session import materialize

LENGTH, SEED = 35, 12
_U = np.uint64
_RUN_BITS = 12  # of a packed run: bits for its length; the start has the rest
_STEP = 0x9E3779B97F4A7C15
_ANCHORS = "doc_id bigint, text_hash bigint, n_words bigint, kept_sha256 string, anchors array<struct<anchor:bigint,context:bigint,run:bigint>>"
_WINDOWS = "doc_id bigint, text_hash bigint, anchor bigint, window bigint, start bigint, n bigint"
_KEPT = "doc_id bigint, text_hash bigint, n_removed bigint, kept_sha256 string"


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    out, factor, m = np.zeros(max(0, len(h) - n + 1), _U), 1, len(h) - n + 1
    if m <= 0:
        return out
    for j in range(n):
        out += h[j: j + m] * _U(factor)
        factor = factor * _STEP % (1 << 64)
    return W.mix(out)


def _last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` values from each place on; of equal ones the last."""
    at, span = np.arange(len(values)), 1
    while span < width:
        more = min(span, width - span)
        left, right = at[: len(at) - more], at[more:]
        at = np.where(values[right] <= values[left], right, left)
        span += more
    return at


class Runs:
    """Anchors of texts, each with the run of windows it stands for. Texts are given as words: text index, in order,
    and hash of each."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, length: int = LENGTH, seed: int = SEED):
        none = np.zeros(0, np.int64)
        self.doc, self.anchor, self.context, self.start, self.size = none, none.view(_U), none.view(_U), none, none
        if len(h) < length:
            return
        grams = _rolled(h, seed)
        at = _last_smallest(grams, length - seed + 1)
        windows = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1:])
        if not len(windows):
            return
        at = at[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        self.size = np.diff(np.append(first, len(windows)))
        lo, at = windows[first], at[first]
        self.doc, self.anchor = doc[lo], grams[at]
        begin = np.searchsorted(doc, doc[lo], "left")
        self.start = lo - begin
        steps, back = W._powers(_STEP, len(h) + 1), W._powers(pow(_STEP, -1, 1 << 64), len(h) + 1)
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(h * steps[: len(h)], out=sums[1:])
        hi = lo + self.size + length - 1
        self.context = W.mix((sums[hi] - sums[lo]) * back[lo] + W.mix(((at - lo) << 20 | self.size).astype(_U)))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The given words of ``data``, joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    take = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
    last = begin + size - 1
    take[last] = 0
    out = data[take]
    out[last] = 32
    return out[:-1].tobytes()


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, data, word counts, text index, starts, ends) of slices of the texts."""
    data, offsets = W.text_bytes(batch.column("text"))
    for lo, hi in W.slices(offsets):
        part = data[offsets[lo]: offsets[hi]]
        doc, starts, ends = W.spans(part, offsets[lo: hi + 1] - offsets[lo], W.NOT_SPACE)
        yield lo, hi, part, np.bincount(doc, minlength=hi - lo), doc, starts, ends


def _anchored(length: int, seed: int):
    runs_type = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("run", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, n, doc, starts, ends in _each(batch):
                r = Runs(doc, W.hashes(data, starts, ends, lower=False), length, seed)
                cut = np.append(0, np.cumsum(n))
                sha = [hashlib.sha256(_joined(data, starts[a:b], ends[a:b])).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
                items = pa.StructArray.from_arrays([
                    pa.array(r.anchor.view(np.int64)), pa.array(r.context.view(np.int64)), pa.array(r.start << _RUN_BITS | r.size)],
                    fields=list(runs_type.value_type))
                bounds = np.append(0, np.cumsum(np.bincount(r.doc, minlength=hi - lo))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                    pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), items).cast(runs_type),
                ], ["doc_id", "text_hash", "n_words", "kept_sha256", "anchors"])

    return run


def _listed(column: pa.Array, field: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0])
    values = values.field(field) if field else values
    return at - at[0], values.to_numpy(zero_copy_only=False)


def _windowed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, packed = _listed(batch.column("classes"), "run")
            anchor, count = (_listed(batch.column("classes"), c)[1] for c in ("anchor", "n"))
            for lo, hi, data, n, doc, starts, ends in _each(batch):
                whole = _rolled(W.hashes(data, starts, ends, lower=False), length)
                first = np.cumsum(n) - n
                a, b = bounds[lo], bounds[hi]
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo: hi + 1]))
                size = packed[a:b] & ((1 << _RUN_BITS) - 1)
                which = np.repeat(np.arange(b - a), size)
                start = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + (packed[a:b] >> _RUN_BITS)[which]
                row = row[which]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(anchor[a:b][which]),
                    pa.array(whole[first[row] + start].view(np.int64)), pa.array(start), pa.array(count[a:b][which]),
                ], ["doc_id", "text_hash", "anchor", "window", "start", "n"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, first = _listed(batch.column("spans"), "first")
        last = _listed(batch.column("spans"), "last")[1]
        for lo, hi, data, n, doc, starts, ends in _each(batch):
            cut = np.append(0, np.cumsum(n))
            at = cut[np.repeat(np.arange(hi - lo), np.diff(bounds[lo: hi + 1]))]
            delta = np.zeros(len(doc) + 1, np.int64)
            np.add.at(delta, at + first[bounds[lo]: bounds[hi]], 1)
            np.add.at(delta, at + last[bounds[lo]: bounds[hi]], -1)
            keep = np.cumsum(delta)[:-1] == 0
            sha, removed = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                k = keep[a:b]
                removed.append(int(b - a - k.sum()))
                sha.append(hashlib.sha256(_joined(data, starts[a:b][k], ends[a:b][k])).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(removed, pa.int64()),
                pa.array(sha, pa.string())], ["doc_id", "text_hash", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))


def _same(a: DataFrame, b: DataFrame) -> list:
    return [a["doc_id"].eqNullSafe(b["doc_id"]), a["text_hash"] == b["text_hash"]]


def seeds(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, kept_sha256 (of all its words) and its anchors with
    their contexts and runs of windows (start << 12 | number)."""
    return _texts(docs).mapInArrow(_anchored(length, seed), _ANCHORS)


def repeats(docs: DataFrame, anchored: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, first, last): words first to last - 1 of a text belong to windows that stand elsewhere
    too. Spans of one text may overlap. ``anchored`` is the written table of ``seeds(docs)``."""
    places = anchored.select("doc_id", "text_hash", F.explode("anchors").alias("at")).select("doc_id", "text_hash", "at.*")
    often = places.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    often = materialize(often.select("anchor", (F.col("least") != F.col("most")).alias("open")), "repeated")
    places = materialize(places.join(often, "anchor"), "anchors")  # both sides are written tables, so a hot anchor is split
    whole = places.where("not open").select("doc_id", "text_hash", "run")
    classes = places.where("open").groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "run")).alias("at"))
    classes = materialize(classes, "contexts")
    several = places.where("open").join(classes.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(
        "doc_id", "text_hash", "run")
    single = classes.where("n = 1").select("anchor").distinct()
    asked = classes.join(single, "anchor", "left_semi").groupBy("at.doc_id", "at.text_hash").agg(
        F.collect_list(F.struct("anchor", "n", "at.run")).alias("classes"))
    texts = _texts(docs)  # repeated rows give the windows of their classes again, which count several places anyway
    windows = texts.join(asked, _same(texts, asked)).select(texts["doc_id"], texts["text_hash"], "text", "classes").mapInArrow(
        _windowed(length), _WINDOWS)
    windows = materialize(windows, "windows")
    again = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window")
    parts = windows.where("n = 1").join(again, ["anchor", "window"], "left_semi").select(
        "doc_id", "text_hash", F.col("start").alias("first"), (F.col("start") + length).alias("last"))
    size, start = F.col("run").bitwiseAND((1 << _RUN_BITS) - 1), F.shiftright("run", _RUN_BITS)
    return whole.unionByName(several).select("doc_id", "text_hash", start.alias("first"), (start + size + (length - 1)).alias("last")).unionByName(parts)


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of every row."""
    anchored = materialize(seeds(docs, length, seed), "seeds")
    spans = repeats(docs, anchored, length).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    texts = _texts(docs)
    kept = texts.join(spans, _same(texts, spans)).select(texts["doc_id"], texts["text_hash"], "text", "spans").mapInArrow(_cut, _KEPT).distinct()
    rows = anchored.select("doc_id", "text_hash", "n_words", F.col("kept_sha256").alias("all_sha256"))
    return rows.join(kept, _same(rows, kept), "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))

"""License texts in whole documents by an exact set-similarity join.

Blocks: for each template of m words, the document's words in windows of 2 m, one every m, so that any m
words in a row lie in one. A block meets a template when it holds at least ``threshold`` of the template's distinct
words. Tokens are ordered by their frequency over all documents, rarest first:

- prefix filter: a block that meets the template holds one of its first |T| - need + 1 tokens;
- length filter: a block with fewer distinct template tokens than ``need`` is left out before any counting;
- positional filter: after a first match at place i of the order, at most |T| - i tokens can match.

Survivors are counted exactly. Template words and their counts are bounded by the templates, a parameter.

Base labels: places where the words of a phrase stand consecutively. A null text counts as empty: no
words, no labels, score 0. Repeated rows give equal rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they are commonly written.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is dedicated to the public domain": "public-domain",
}
THRESHOLD = 0.9


def _counted(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of each template word over all documents; one row per word reaches the driver."""
    keys = np.sort(np.array([W.hash_word(w) for w in vocabulary], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for lo, hi in W.slices(offsets):
                part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                _, starts, ends = W.spans(part, at, W.ALNUM)
                h = W.hashes(part, starts, ends)
                j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(j[keys[j] == h], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total)], names=["k", "n"])

    rows = docs.select("text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = {int(keys[r.k]): r.n for r in rows}
    return {w: n.get(W.hash_word(w), 0) for w in vocabulary}


class Matcher:
    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str], threshold: float, counts: Mapping[str, int]):
        rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.templates = []
        for text, label in templates.items():
            ws = text.split()
            tokens = sorted({rank[w] for w in ws})  # rarest first
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, len(ws), np.array(tokens), need))
        self.phrases = [([rank[w] for w in p.split()], label) for p, label in phrases.items()]
        order = sorted(rank, key=W.hash_word)
        self.keys = np.array([W.hash_word(w) for w in order], np.uint64)
        self.ranks = np.array([rank[w] for w in order])

    def run(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
        n = len(offsets) - 1
        doc, starts, ends = W.spans(data, offsets, W.ALNUM)
        h = W.hashes(data, starts, ends)
        n_words = np.bincount(doc, minlength=n)
        first = np.cumsum(n_words) - n_words
        j = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[j] == h)  # words of any template, in order
        token, owner = self.ranks[j[at]], doc[at]
        out = [[int(w), 0, None, None, set(), set(), 0.0] for w in n_words]
        for ranks, label in self.phrases:
            hit = np.flatnonzero(token == ranks[0])
            for k, r in enumerate(ranks[1:], 1):
                hit = hit[hit + k < len(at)]
                hit = hit[(token[hit + k] == r) & (at[hit + k] == at[hit] + k) & (owner[hit + k] == owner[hit])]
            for i in hit:
                d, place = owner[i], int(at[i] - first[owner[i]])
                o = out[d]
                o[1] += 1
                o[2], o[3] = place if o[2] is None else min(o[2], place), place if o[3] is None else max(o[3], place)
                o[4].add(label), o[5].add(label)
                o[6] = 1.0
        for label, m, tokens, need in self.templates:
            for d, share in self._blocks(at, token, owner, first, m, tokens, need):
                out[d][5].add(label)
                out[d][6] = max(out[d][6], share)
        return out

    def _blocks(self, at, token, owner, first, m, tokens, need) -> Iterator[tuple[int, float]]:
        """(text, share of the template's tokens) of the blocks that meet the template."""
        mine = np.flatnonzero(np.isin(token, tokens))
        place = np.searchsorted(tokens, token[mine])  # in the global order
        prefix = mine[place <= len(tokens) - need]
        if not len(prefix):
            return
        stride = (at - first[owner]) // m
        # Word at stride s lies in blocks s - 1 and s.
        block = np.unique(np.concatenate([owner[prefix] * (1 << 40) + stride[prefix], owner[prefix] * (1 << 40) + np.maximum(stride[prefix] - 1, 0)]))
        key = owner[mine] * (1 << 40) + stride[mine]
        lo, hi = np.searchsorted(key, block), np.searchsorted(key, block + 1, "right")
        for b, x, y in zip(block[hi - lo >= need], lo[hi - lo >= need], hi[hi - lo >= need]):
            got = np.unique(place[x:y])
            if len(got) < need or len(tokens) - got[0] < need:
                continue
            yield int(b >> 40), len(got) / len(tokens)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for t in (*templates, *phrases) for w in t.split()})
    matcher = Matcher(templates, phrases, threshold, _counted(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            rows = [r for lo, hi in W.slices(offsets) for r in matcher.run(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])]
            c = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:4]),
                *(pa.array([",".join(sorted(v)) for v in x], pa.string()) for x in c[4:6]), pa.array(c[6], pa.float64()),
            ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")

"""Greedy longest-match word-piece counts by a linear automaton.

A trie over the pieces has, for each node, a failure link and the number of pieces that are popped when
the link is taken. A word is read once, byte by byte; its pieces are never built. All distinct words of a
batch advance together, one byte a step.

A null or empty text has no words and no tokens. A word that cannot be cut into pieces counts as one
(unknown) token. Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered. Every row gives one row; columns other
than doc_id and text are not read.
"""
from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.llm import words as W


class Automaton:
    def __init__(self, pieces: Iterable[bytes]):
        pieces = set(pieces) - {b""}
        child: dict[tuple[int, int], int] = {}
        parents, letters, whole = [0], [0], [False]
        for piece in sorted(pieces):
            u = 0
            for c in piece:
                v = child.get((u, c))
                if v is None:
                    v = child[u, c] = len(parents)
                    parents.append(u), letters.append(c), whole.append(False)
                u = v
            whole[u] = True
        n = len(parents)
        # A sorted trie numbers parents before children, but links need shorter strings first.
        depth = [0] * n
        for u in range(1, n):
            depth[u] = depth[parents[u]] + 1
        link, popped = [-1] * n, [0] * n
        for u in sorted(range(1, n), key=depth.__getitem__):
            if whole[u]:
                link[u], popped[u] = 0, 1
                continue
            z, count = link[parents[u]], popped[parents[u]]
            while z >= 0 and (z, letters[u]) not in child:
                count += popped[z]
                z = link[z]
            if z >= 0:
                link[u], popped[u] = child[z, letters[u]], count
        self.goto = np.full((n, 256), -1, np.int32)
        for (u, c), v in child.items():
            self.goto[u, c] = v
        self.link, self.popped = np.array(link, np.int32), np.array(popped, np.int32)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of pieces of each word; ``data`` is lowered already."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: the active ones are a prefix
        at, length = starts[order], (ends - starts)[order]
        u, count = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        dead = np.zeros(len(at), bool)
        for step in range(int(length[0]) if len(at) else 0):
            m = int(np.searchsorted(-length, -step, "left"))
            c = data[at[:m] + step]
            v = self.goto[u[:m], c]
            stuck = np.flatnonzero(v < 0)
            while len(stuck):
                back = u[stuck]
                to = self.link[back]
                dead[stuck[to < 0]] = True
                stuck, back, to = stuck[to >= 0], back[to >= 0], to[to >= 0]
                count[stuck] += self.popped[back]
                u[stuck] = to
                w = self.goto[to, c[stuck]]
                v[stuck] = w
                stuck = stuck[w < 0]
            u[:m] = np.where(v < 0, 0, v)
        left = np.flatnonzero((u > 0) & ~dead)
        while len(left):
            to = self.link[u[left]]
            dead[left[to < 0]] = True
            left, to = left[to >= 0], to[to >= 0]
            count[left] += self.popped[u[left]]
            u[left] = to
            left = left[to > 0]
        count[dead] = 1
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies show each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file, without its word-end marks and special tokens."""
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    special, byte_of = {t["content"] for t in table["added_tokens"]}, _byte_of()
    return [bytes(byte_of[c] for c in t.removesuffix("</w>")) for t in table["model"]["vocab"] if t not in special]


@functools.lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def piece_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary_path)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            n_words, n_tokens = [], []
            for lo, hi in W.slices(offsets):
                part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                doc, starts, ends = W.spans(part, at, W.NOT_SPACE)
                _, first, inverse = np.unique(W.hashes(part, starts, ends), return_index=True, return_inverse=True)
                count = auto.counts(W.LOWER[part], starts[first], ends[first])
                n_words.append(np.bincount(doc, minlength=hi - lo))
                n_tokens.append(np.bincount(doc, weights=count[inverse], minlength=hi - lo).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_words, n_tokens)],
                names=["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")

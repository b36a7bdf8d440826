"""Quality score of whole texts by a byte-level convolutional network, trained and run in numpy.

A document is covered by overlapping chunks of ``2 * STRIDE`` bytes, one every ``STRIDE``. Learned filters
of ``WIDTH`` bytes run over every position; each filter is max-pooled within a chunk; a small layer makes
one logit per chunk, and the mean over all chunks of the document one probability.

The network is fitted on the driver on a bounded sample: at most ``sample`` labelled rows, chosen by hash of
doc_id, with at most ``CHUNKS`` chunks of each, spread evenly over its whole text. Scoring reads whole texts.

A null text counts as empty and is scored like one (the score of a blank chunk). Labels that are null are not
learned from; a doc_id labelled twice counts with its larger label. Without any labelled row every score is
0.5. Repeated rows get equal scores; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W

WIDTH, FILTERS, HIDDEN, STRIDE, CHUNKS = 5, 16, 16, 128, 8
SAMPLE = 3000
_PIECE = 256 << 10


class Network:
    """Tables of filter values per byte and offset, and two dense layers."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {
            "t": rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32),
        }

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0)
        return h, h @ self.p["w2"] + self.p["b2"]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability per text."""
        n = len(offsets) - 1
        out = np.empty(n)
        for lo, hi in W.slices(offsets, _PIECE):
            size = offsets[lo + 1: hi + 1] - offsets[lo: hi]
            if hi - lo == 1 and size[0] > 4 * _PIECE:
                out[lo] = self._long(data[offsets[lo]: offsets[hi]])
                continue
            total, chunks = self._logits(data[offsets[lo]: offsets[hi]], size)
            out[lo:hi] = total / chunks
        return 1 / (1 + np.exp(-out))

    def _long(self, data: np.ndarray) -> float:
        """The mean logit of one very long text, some chunks at a time; cuts fall on strides."""
        total = chunks = 0.0
        step = _PIECE // STRIDE * STRIDE
        for a in range(0, len(data), step):
            last = a + step >= len(data)
            t, c = self._logits(data[a: a + step + (0 if last else STRIDE + WIDTH - 1)], None, None if last else step)
            total, chunks = total + t[0], chunks + c[0]
        return total / chunks

    def _logits(self, data: np.ndarray, size: np.ndarray | None, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sum of chunk logits and number of chunks per text. With ``step`` the one text goes on behind the
        first ``step`` bytes, and only chunks that start within them count."""
        size = np.array([len(data)]) if size is None else size
        n = np.maximum(size, 1)  # positions; every text is padded with zero bytes at its end
        base = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)
        padded = np.zeros(int((n + WIDTH - 1).sum()), np.uint8)
        padded[np.arange(len(data)) + np.repeat(base - (np.cumsum(size) - size), size)] = data
        act = np.take(self.p["t"][0], padded[: len(padded) - WIDTH + 1], axis=0)
        for k in range(1, WIDTH):
            act += np.take(self.p["t"][k], padded[k: len(padded) - WIDTH + 1 + k], axis=0)
        blocks = -(-n // STRIDE)
        at = np.repeat(base, blocks) + STRIDE * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        ends = np.minimum(at + STRIDE, np.repeat(base + n, blocks))
        edges = np.stack([at, ends], 1).ravel()  # the parts between texts are computed and left out
        if edges[-1] >= len(act):
            edges = edges[:-1]
        top = np.maximum.reduceat(act, edges, axis=0)[::2]
        first = np.cumsum(blocks) - blocks
        follows = np.ones(len(at), bool)
        follows[first + blocks - 1] = False
        pooled = top.copy()
        pooled[follows] = np.maximum(top[follows], top[np.flatnonzero(follows) + 1])
        # A text of several blocks has one chunk fewer: its last block lies in the chunk before.
        counts = np.maximum(blocks - 1, 1)
        use = follows | np.repeat(blocks == 1, blocks)
        if step is not None:
            counts, use = np.array([step // STRIDE]), np.arange(len(at)) < step // STRIDE
        _, z = self.head(np.maximum(pooled[use] + self.p["b"], 0))
        return np.add.reduceat(z, np.cumsum(counts) - counts), counts

    def fit(self, chunks: list[np.ndarray], labels: np.ndarray, epochs: int = 12, seed: int = 2) -> "Network":
        """Adam on the log loss; ``chunks`` holds (n, 2 * STRIDE + WIDTH - 1) bytes per document."""
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), 64):
                docs = order[a: a + 64]
                g = self._gradient([chunks[d] for d in docs], labels[docs])
                t += 1
                rate = 0.01 * (1 - 0.8 * epoch / epochs)
                for k, v in g.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    self.p[k] -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)
        return self

    def _gradient(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        b = np.concatenate(docs)
        n = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(len(n)), n)
        span = b.shape[1] - WIDTH + 1
        act = self.p["t"][0][b[:, :span]]
        for k in range(1, WIDTH):
            act += self.p["t"][k][b[:, k: k + span]]
        arg = act.argmax(1)
        best = np.take_along_axis(act, arg[:, None, :], 1)[:, 0] + self.p["b"]
        pooled = np.maximum(best, 0)
        h, z = self.head(pooled)
        p = 1 / (1 + np.exp(-np.bincount(doc, weights=z) / n))
        dz = ((p - y) / n / len(n))[doc].astype(np.float32)
        dh = dz[:, None] * self.p["w2"] * (h > 0)
        dm = (dh @ self.p["w1"].T) * (best > 0)
        g = {"w2": h.T @ dz, "b2": dz.sum(keepdims=True), "w1": pooled.T @ dh, "b1": dh.sum(0), "b": dm.sum(0)}
        rows, f = np.arange(len(b))[:, None], np.arange(FILTERS)
        g["t"] = np.stack([
            np.bincount((b[rows, arg + k].astype(np.int64) * FILTERS + f).ravel(), weights=dm.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            for k in range(WIDTH)]).astype(np.float32)
        return {k: v + 1e-5 * self.p[k] for k, v in g.items()}


def sample_chunks(text: bytes, limit: int = CHUNKS) -> bytes:
    """At most ``limit`` chunks of a text, evenly spread, padded with zeros, one after another."""
    size = 2 * STRIDE + WIDTH - 1
    n = max(1, -(-len(text) // STRIDE) - 1)
    at = range(n) if n <= limit else sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)})
    return b"".join(text[i * STRIDE: i * STRIDE + size][: size].ljust(size, b"\0") for i in at)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> list:
    """(label, chunks) of at most ``sample`` labelled rows; the ids, bounded too, are broadcast."""
    chosen = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sample_chunks((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(texts, pa.binary())], names=["doc_id", "label", "chunks"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id bigint, label int, chunks binary")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "chunks").limit(sample).collect()


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Network | None:
    """``labels`` has doc_id and label (0 or 1); ``learn`` says which of its rows may be learned from."""
    rows = training_sample(docs, labels, learn, sample)
    if not rows:
        return None
    chunks = [np.frombuffer(r.chunks, np.uint8).reshape(-1, 2 * STRIDE + WIDTH - 1) for r in rows]
    return Network().fit(chunks, np.array([float(r.label) for r in rows]))


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            p = network.scores(data, offsets) if network else np.full(len(offsets) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def filtered(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``least`` or more. No shuffle and no join: the
    score is a column of the same scan."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        data, offsets = W.text_bytes(texts)
        return pa.array(network.scores(data, offsets) if network else np.full(len(texts), 0.5))

    return docs.where(scored(F.col("text")) >= least)

"""Languages of the words of code-switched text by a linear-chain conditional random field.

Features of a word (A-Z lowered, UTF-8 bytes): the word itself (lexicon), its affixes of 1 to 3 bytes, and
its byte 2- and 3-grams with word edges; each is hashed to one of ``BUCKETS`` rows of weights. Transitions between
neighbouring labels are learned with them. Words are labelled by the marginals of forward-backward over
the whole document; the document gets the label with the largest sum of marginals, ties to the first by
name, and the score is its share.

The labels are those of all rows to learn from. Fitted on the driver on a bounded sample: ``sample`` texts with a non-null
label, chosen by hash of doc_id, and of each label at least its share of ``sample`` among all labels alike, or all it has; up
to ``PIECES`` runs of ``RUN`` words spread over each whole text. Prediction reads whole texts and no other column.

A null text, or one without a letter, is ``und`` with score 0. A text with letters always has words. Without
training rows every text is ``und``. Repeated rows get equal results.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm import words as W

BUCKETS, SAMPLE, PIECES, RUN = 1 << 16, 2500, 4, 48
UNKNOWN = "und"
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_U = np.uint64


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each word, buckets of all words one after another); ``keys`` are the words' hashes."""
    length = ends - starts
    n = len(starts)
    # Each word with an edge byte on both sides, one after another.
    size = length + 2
    base = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 32, _U)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    low = W.LOWER[data[np.repeat(starts, length) + inner]].astype(_U)
    flat[np.repeat(base + 1, length) + inner] = low
    kinds = []  # (position in the word's list, bucket code)
    two = flat[:-1] * _U(256) + flat[1:]
    three = two[:-1] * _U(256) + flat[2:] if len(two) > 1 else two[:0]
    words = np.arange(n)
    kinds.append((words, keys))
    for k in (1, 2, 3):
        code = flat[base + 1]
        for j in range(1, k):
            code = code * _U(256) + flat[np.minimum(base + 1 + j, base + size - 1)]
        kinds.append((words, code * _U(8) + _U(k)))
        code = flat[base + size - 2]
        for j in range(1, k):
            code = code * _U(256) + flat[np.maximum(base + size - 2 - j, base)]
        kinds.append((words, code * _U(8) + _U(k + 3)))
    owner = np.repeat(words, size)
    ok2 = np.flatnonzero(owner[:-1] == owner[1:])
    kinds.append((owner[ok2], two[ok2] * _U(64) + _U(9)))
    ok3 = np.flatnonzero(owner[:-2] == owner[2:])
    kinds.append((owner[ok3], three[ok3] * _U(64) + _U(10)))
    counts = 7 + (size - 1) + (size - 2)
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    used = np.zeros(n, np.int64)
    for owners, code in kinds:
        per = np.bincount(owners, minlength=n)
        rank = np.arange(len(owners)) - np.repeat(np.cumsum(per) - per, per)
        out[first[owners] + used[owners] + rank] = (W.mix(code) % _U(BUCKETS)).astype(np.int32)
        used += per
    return first, out


class Chain:
    def __init__(self, names: list[str]):
        self.names, k = names, len(names)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.moves = np.zeros((k, k))

    def emissions(self, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[buckets], first, axis=0).astype(float) if len(first) else np.zeros((0, len(self.names)))

    def messages(self, emit: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward and backward messages of every word; chains lie one after another in ``emit``."""
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        e = np.exp(emit - emit.max(1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        forth, back = e.copy(), np.ones_like(e)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")
        if steps:
            forth[first[: active[0]]] /= forth[first[: active[0]]].sum(1, keepdims=True)
        for t in range(1, steps):
            at = first[: active[t]] + t
            v = (forth[at - 1] @ move) * e[at]
            forth[at] = v / v.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            at = first[: active[t + 1]] + t
            v = (back[at + 1] * e[at + 1]) @ move.T
            back[at] = v / v.sum(1, keepdims=True)
        return forth, back

    def marginals(self, emit: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        forth, back = self.messages(emit, first, length)
        p = forth * back
        return p / p.sum(1, keepdims=True)

    def fit(self, runs: list[np.ndarray], labels: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, epochs: int = 4, seed: int = 3) -> "Chain":
        """AdaGrad on the log likelihood. A run is an array of indices of words, all with one label."""
        rng = np.random.default_rng(seed)
        first, buckets = features(data, starts, ends, W.hashes(data, starts, ends))
        count = np.diff(np.append(first, len(buckets)))
        k = len(self.names)
        seen, seen_moves = np.full(self.weights.shape, 1e-3, np.float32), np.full((k, k), 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(runs))
            for a in range(0, len(order), 128):
                batch = order[a: a + 128]
                length = np.array([len(runs[r]) for r in batch])
                at = np.cumsum(length) - length
                index = np.concatenate([runs[r] for r in batch])
                n = count[index]
                own = np.cumsum(n) - n
                b = buckets[np.repeat(first[index] - own, n) + np.arange(int(n.sum()))]
                emit = self.emissions(own, b)
                forth, back = self.messages(emit, at, length)
                p = forth * back
                p /= p.sum(1, keepdims=True)
                gold = np.repeat(labels[batch], length)
                d = p
                d[np.arange(len(gold)), gold] -= 1
                spread = np.repeat(d, n, axis=0)
                g = np.stack([np.bincount(b, weights=spread[:, j], minlength=BUCKETS) for j in range(k)], 1).astype(np.float32) / len(batch)
                inner = np.setdiff1d(np.arange(len(gold)), at)  # words that follow another of their run
                e = np.exp(emit - emit.max(1, keepdims=True))
                pair = forth[inner - 1][:, :, None] * np.exp(self.moves - self.moves.max()) * (e[inner] * back[inner])[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                gm = pair.sum(0) - np.diag(np.bincount(gold[inner], minlength=k))
                gm = gm / len(batch) + 0.05 * self.moves
                g += 1e-5 * self.weights
                seen += g * g
                seen_moves += gm * gm
                self.weights -= 0.1 * g / np.sqrt(seen)
                self.moves -= 0.1 * gm / np.sqrt(seen_moves)
        return self

    def label_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of some texts (text index, start, end), their marginals, and whether each text has a letter."""
        doc, starts, ends = W.spans(data, offsets, W.ALNUM)
        key = W.hashes(data, starts, ends)
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        emit = self.emissions(*features(data, starts[one], ends[one], key[one]))[inverse] if len(one) else np.zeros((0, len(self.names)))
        length = np.bincount(doc, minlength=len(offsets) - 1)
        some = np.flatnonzero(length)
        p = self.marginals(emit, (np.cumsum(length) - length)[some], length[some]) if len(some) else emit
        return doc, starts, ends, p, has_letter(data, offsets)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for lo, hi in W.slices(offsets):
            doc, _, _, p, lettered = self.label_texts(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            mass = np.stack([np.bincount(doc, weights=p[:, j], minlength=hi - lo) for j in range(len(self.names))], 1)
            best = mass.argmax(1)
            names += [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores.append(np.where(lettered, mass.max(1) / np.maximum(mass.sum(1), 1e-300), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    found = np.zeros(n, bool)
    if len(data):
        hit = np.flatnonzero(_LETTER[data])
        found[np.searchsorted(offsets, hit, "right") - 1] = True
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i]: offsets[i + 1]].tobytes().decode())
    return found


def _runs(text: str) -> str:
    """Up to PIECES runs of RUN words, spread over the whole text, one line each."""
    words = [w for w in text.split()]
    n = max(1, -(-len(words) // RUN))
    at = range(n) if n <= PIECES else sorted({round(i * (n - 1) / (PIECES - 1)) for i in range(PIECES)})
    return "\n".join(" ".join(words[i * RUN: (i + 1) * RUN]) for i in at)


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Chain | None:
    """``docs`` has doc_id, text, lang; ``learn`` says which rows may be learned from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_runs(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), batch.column("lang")], names=["runs", "lang"])

    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # Ids first: no text takes part in the choice. Few rows can share the last hash.
    order = F.xxhash64("doc_id", F.lit(5))
    edge = usable.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return None
    ranked = [order, F.col("doc_id"), F.col("text"), F.col("lang")]
    label = F.col("lang").cast("string")
    short = lambda some: some.select("text", label.alias("lang")).mapInArrow(cut, "runs string, lang string").collect()
    rows = short(usable.where(order <= edge).orderBy(*ranked).limit(sample))
    # One row a label reaches the driver.
    have = {r.lang: r.n for r in usable.groupBy(label.alias("lang")).agg(F.count("*").alias("n")).collect()}
    names = sorted(have)
    got, least = Counter(r.lang for r in rows), -(-sample // len(names))
    scarce = [x for x in names if got[x] < min(have[x], least)]
    if scarce:
        # Hashes alone choose: of each label up to ``least`` leave a task. Their texts are fetched after that.
        ranks = Window.partitionBy("label").orderBy("h")
        hashes = usable.where(label.isin(scarce)).select(label.alias("label"), order.alias("h")).withColumn("place", F.row_number().over(ranks))
        edges = hashes.where(F.col("place") <= least).groupBy("label").agg(F.max("h").alias("edge")).collect()
        rows = [r for r in rows if r.lang not in scarce]
        for of, last in sorted(edges):
            rows += sorted(short(usable.where((label == of) & (order <= last)).orderBy(*ranked).limit(least)))
    lines = [(line, names.index(r.lang)) for r in rows for line in r.runs.split("\n")]
    data, offsets = W.text_bytes(pa.array([x for x, _ in lines], pa.string()))
    doc, starts, ends = W.spans(data, offsets, W.ALNUM)
    if not len(starts):
        return None
    cuts = np.flatnonzero(np.diff(doc)) + 1
    runs = np.split(np.arange(len(doc)), cuts)
    return Chain(names).fit(runs, np.array([lines[doc[r[0]]][1] for r in runs]), data, starts, ends)


def identify(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            names, scores = chain.predict(data, offsets) if chain else ([UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def word_labels(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, word_no, word, lang, score: one row per word of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for lo, hi in W.slices(offsets):
                part = data[offsets[lo]: offsets[hi]]
                doc, starts, ends, p, _ = chain.label_texts(part, offsets[lo: hi + 1] - offsets[lo])
                raw, best = part.tobytes(), p.argmax(1) if len(p) else np.zeros(0, int)
                n = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc + lo)), pa.array(np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)),
                    pa.array([raw[a:b].decode() for a, b in zip(starts, ends)], pa.string()),
                    pa.array([chain.names[b] for b in best], pa.string()), pa.array(p.max(1) if len(p) else np.zeros(0)),
                ], names=["doc_id", "word_no", "word", "lang", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id bigint, word_no bigint, word string, lang string, score double")

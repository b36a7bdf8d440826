"""Log probability of whole texts by a causal self-attention model over subword ids, trained in numpy.

Ids come from a public tokenizer; one end follows each text. The model gives p(class | context) * p(id | class), and what the
counts of neighbouring ids leave over is given out by it: p(id | id before, context) = max(n - ``DISCOUNT``, 0) / n(id before) + rest * p(class | context) * p(id | class),
and within a word once more with the two ids before, what is left over going by p(id | id before, context).

All of it is learned from all training documents, whole:

- classes of ids: k-means on which (hashed) ids stand before and after them;
- counts of every id and of neighbouring classes. The first give p(id | class), the second a prior of the next class;
- counts of neighbouring ids, two and, where the middle one leaves its word open, three; all of them. Those seen most, up to
  ``FOLLOWERS``, are held by every scoring task. The others stay in a table: each part of the texts asks for those of its runs
  that are not held, by one join, and is scored with what it gets;
- a layer of masked self-attention and a small dense layer correct the prior. Every block of every training text takes part
  in fitting them: in each of ``ROUNDS`` rounds every task runs Adam over its share of the round's blocks, ``BATCH`` at a time,
  from the same weights, and the results are averaged by number of blocks. Steps and work grow with the blocks; a task
  gets ``DRAWS`` blocks or more, and fewer in all are gone through several times.

Windows of 2 * ``STRIDE`` positions overlap by half: each id is scored once, in the second half (or at the start), and sees
``STRIDE`` ids before its block and those of its block before itself.

One pass encodes all texts and writes their ids to the shared folder, with the counts of words, ids and neighbouring ids
of its training texts; counting classes, fitting and scoring read the ids from there.

The base score is a word unigram with add-one smoothing: counts of all training words, by one shuffle
of (word, count) rows. The words seen most, up to ``HELD_WORDS``, are held by every task that reads texts; the other
words of each text meet their counts in one join.

A null text counts as empty: one token, the end. A null doc_id is trained on. Repeated rows give equal rows. Without
training rows all counts are zero. Columns other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.llm.encoder import word_encoder
from packloom.session import ROW_GROUP_BYTES, materialize, scratch_path

STRIDE, DIM, HIDDEN, CLASSES, ROWS = 32, 16, 32, 64, 2048
ROUNDS, BATCH, DRAWS = 8, 128, 32_000
NEAR, SELDOM = 64, 3
FOLLOWERS, DISCOUNT = 1 << 21, 0.6
HELD_WORDS = 1 << 20
_RUNS_AT_ONCE = 1 << 21  # distinct runs of ids that a task adds up before it gives them out
_CLIP, _AT_ONCE = np.float32(60), 128
_NO_ID = -(1 << 62)
_TEXT, _WORD, _COUNT, _NEIGHBOUR = 0, 1, 2, 3
_CHUNKS = 64


def blocks(
    ids: np.ndarray, count: np.ndarray, end: int, turn: np.ndarray | None = None, turns: int = 1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, 2 * STRIDE), targets (n, STRIDE), both -1 where there is none, and the text of each block.

    With ``turn``, one for each text, only every ``turns``-th block of it, from another one for each turn."""
    n = count + 1
    first = np.cumsum(n) - n
    per = -(-n // STRIDE)
    text = np.repeat(np.arange(len(n)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    if turn is not None:
        some = np.flatnonzero((number + turn[text]) % turns == 0)
        text, number = text[some], number[some]
    ended = np.full(len(ids) + len(count) + 1 + 3 * STRIDE, -1, np.int64)
    ended[STRIDE: STRIDE + len(ids) + len(count) + 1] = _ended(ids, count, end)
    at = first[text] + STRIDE * number
    source = np.lib.stride_tricks.sliding_window_view(ended, 2 * STRIDE)[at]
    target = np.lib.stride_tricks.sliding_window_view(ended, STRIDE)[at + STRIDE + 1]
    source[number == 0, :STRIDE] = -1
    left = n[text] - STRIDE * number
    short = np.flatnonzero(left < STRIDE)
    row, column = np.nonzero(np.arange(STRIDE) >= left[short, None])
    source[short[row], STRIDE + column] = target[short[row], column] = -1
    return source, target, text


def _in_order(wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of 0 or more, in parts, sorted, each with the place it comes from. Number and place are sorted as one, which is several
    times as fast as sorting places."""
    bits = 63 - int(wanted.max(initial=1)).bit_length()
    if bits < 10:
        order = np.argsort(wanted)
        yield wanted[order], order
        return
    for a in range(0, len(wanted), 1 << bits):
        part = wanted[a: a + (1 << bits)] << bits
        part |= np.arange(len(part))
        part.sort()
        yield part >> bits, a + (part & ((1 << bits) - 1))


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among the sorted ones, -1 if it is none of them."""
    out = np.full(len(wanted), -1)
    if len(keys):
        for some, order in _in_order(wanted):  # sorted keys are looked up faster
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            out[order] = np.where(keys[at] == some, at, -1)
    return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """The value of each wanted key among the sorted ones, ``other`` where it is none of them."""
    return np.append(values, other)[_places(keys, wanted)]


class AttentionModel:
    def __init__(self, class_of: np.ndarray, inner: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s, k=0.2: rng.normal(0, k, s).astype(np.float32)
        self.class_of = class_of
        self.p = {
            "class": g(CLASSES, DIM), "row": g(ROWS, DIM, k=0.05), "place": g(2 * STRIDE, DIM, k=0.05), "q": g(DIM, DIM), "k": g(DIM, DIM),
            "v": g(DIM, DIM), "o": g(DIM, DIM), "w1": g(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": g(HIDDEN, CLASSES, k=0.02),
            "b2": np.zeros(CLASSES, np.float32),
        }
        self.prior = np.zeros((CLASSES, CLASSES), np.float32)
        self.within = np.zeros(len(class_of))
        self.n_ids = len(class_of)
        self.inner = np.zeros(self.n_ids, bool) if inner is None else inner
        self.learn_runs(np.ones(self.n_ids), np.zeros(0, np.int64), np.zeros(0))
        self.learn_others(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.causal = (np.arange(2 * STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE).astype(np.float32)

    def learn_counts(self, ids: np.ndarray, pairs: np.ndarray) -> None:
        """p(id | class) and p(class | class before) with add-one smoothing."""
        total = np.bincount(self.class_of, weights=ids + 1.0, minlength=CLASSES)
        self.within = np.log(ids + 1.0) - np.log(total)[self.class_of]
        smooth = pairs + 1.0
        self.prior = (np.log(smooth) - np.log(smooth.sum(1, keepdims=True))).astype(np.float32)

    def learn_runs(
        self, ids: np.ndarray, keys: np.ndarray, n: np.ndarray, given: np.ndarray | None = None, first_given: np.ndarray | None = None,
    ) -> None:
        """``n`` of each held run of ids, see ``run_keys``; with a run of three its first two are held. ``ids`` counts every id.
        Where there are other runs, ``given`` and ``first_given`` are what all runs that go on from one, or from an id, hold."""
        order = np.argsort(keys)
        self.keys, n = keys[order], n[order]
        two = np.searchsorted(self.keys, self.n_ids ** 2)
        before, context = self.keys[:two] // self.n_ids, self.keys[two:] // self.n_ids - self.n_ids
        self.ids, self.two_n = ids, n[:two]
        total = np.concatenate([ids[before], n[np.searchsorted(self.keys[:two], context)]])
        self.share = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
        if given is None:
            self.rest = np.maximum(1 - np.bincount(before, weights=self.share[:two], minlength=self.n_ids), 1e-12)
            self.contexts, at = np.unique(context, return_inverse=True)
            self.context_rest = np.maximum(1 - np.bincount(at, weights=self.share[two:], minlength=len(self.contexts)), 1e-12)
        else:
            self.rest = np.maximum(1 - first_given / np.maximum(ids, 1), 1e-12)
            given = given[order][:two]
            some = np.flatnonzero(given > 0)
            self.contexts, self.context_rest = self.keys[some], np.maximum(1 - given[some] / n[some], 1e-12)
        self.held_rest = np.ones(len(self.keys) + 1)  # of each held run, as what others go on from; the last is for none
        self.held_rest[np.searchsorted(self.keys, self.contexts)] = self.context_rest

    def learn_others(self, keys: np.ndarray, n: np.ndarray, given: np.ndarray) -> None:
        """The runs that are not held, as far as the texts scored next have them; with a run of three its first two, held or not."""
        self.other_keys, first = np.unique(keys, return_index=True)
        n, given = n[first], given[first]
        two = np.searchsorted(self.other_keys, self.n_ids ** 2)
        held = np.searchsorted(self.keys, self.n_ids ** 2)
        context = self.other_keys[two:] // self.n_ids - self.n_ids
        total = _found(self.keys[:held], self.two_n, context, 0.0) + _found(self.other_keys[:two], n[:two], context, 0.0)
        total = np.concatenate([self.ids[self.other_keys[:two] // self.n_ids], total])
        self.other_share = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
        some = np.flatnonzero(given[:two] > 0)
        self.other_contexts, self.other_rest = self.other_keys[some], np.maximum(1 - given[some] / n[some], 1e-12)

    def _share(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each run holds of its context, and where it stands among the held runs, -1 if it is none of them."""
        at = _places(self.keys, keys)
        share = np.where(at >= 0, self.share[at] if len(self.share) else 0.0, 0.0)
        if len(self.other_keys):
            left = np.flatnonzero(at < 0)
            share[left] = _found(self.other_keys, self.other_share, keys[left], 0.0)
        return share, at

    def _context_rest(self, context: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at``: where the context stands among the held runs."""
        rest = self.held_rest[at]
        if len(self.other_contexts):
            left = np.flatnonzero(at < 0)
            rest[left] *= _found(self.other_contexts, self.other_rest, context[left], 1.0)
        return rest

    def blended(self, earlier: np.ndarray, before: np.ndarray, goal: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each goal, given the two ids before it and the attention model's own log."""
        two = before * self.n_ids + goal
        share, at = self._share(two)
        p = share + self.rest[before] * np.exp(log_p)
        some = np.flatnonzero(self.inner[before])
        context = earlier[some] * self.n_ids + before[some]
        context_at = at[some - 1]  # where ids follow each other, a context is the run before
        other = np.flatnonzero(two[some - 1] != context)
        context_at[other] = _places(self.keys, context[other])
        p[some] = self._share((context + self.n_ids) * self.n_ids + goal[some])[0] + self._context_rest(context, context_at) * p[some]
        return np.log(p)

    def _products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights as they are applied to positions, whose last column is 1: query times key, value times output, and the dense layer with its bias."""
        p = self.p
        near, far = np.zeros((DIM + 1, DIM), np.float32), np.zeros((DIM + 1, DIM + 1), np.float32)
        near[:DIM], far[:DIM, :DIM] = (p["q"] @ p["k"].T) * np.float32(DIM ** -0.5), p["v"] @ p["o"]
        return near, far, np.concatenate([p["w1"], p["b1"][None]])

    def _forward(self, source: np.ndarray) -> dict[str, np.ndarray]:
        p, gone = self.p, np.nonzero(source < 0)
        ids = np.maximum(source, 0)
        c, row = self.class_of[ids], ids % ROWS
        x = np.take(p["class"], c, axis=0)
        x += np.take(p["row"], row, axis=0)
        x += p["place"]
        xq = x[:, STRIDE:]
        q, k, v = xq @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(DIM ** -0.5)
        s = _clipped(s)
        np.exp(s, out=s)
        s *= self.causal
        s[gone[0], :, gone[1]] = 0
        s /= s.sum(2, keepdims=True)
        o = s @ v
        z = o @ p["o"]
        z += xq
        h = z @ p["w1"]
        h += p["b1"]
        np.maximum(h, 0, out=h)
        logits = h @ p["w2"]
        logits += p["b2"]
        logits += np.take(self.prior, c[:, STRIDE:], axis=0)
        return {"gone": gone, "c": c, "row": row, "x": x, "q": q, "k": k, "v": v, "a": s, "o": o, "z": z, "h": h, "logits": _clipped(logits)}

    def log_probabilities(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target, 0 where there is none."""
        return Scorer(self).log_probabilities(source, target)

    def packed(self) -> np.ndarray:
        """All weights, one after another."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> "AttentionModel":
        ends = np.cumsum([v.size for v in self.p.values()])
        self.p = {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(flat.astype(np.float32), ends[:-1]))}
        return self

    def fit(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> "AttentionModel":
        """One step of Adam for each batch of inputs and targets."""
        flat = self.packed()
        ends = np.cumsum([v.size for v in self.p.values()])
        self.p = {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(flat, ends[:-1]))}  # a step changes all of them at once
        m, s = np.zeros_like(flat), np.zeros_like(flat)
        for t, (source, target) in enumerate(batches, 1):
            got = self._gradient(source, target)
            g = np.concatenate([got[name].ravel() for name in self.p])
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            flat -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        return self

    def _gradient(self, source: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(source)
        known = target >= 0
        h, a, d = f["h"], f["a"], f["logits"]
        np.exp(d, out=d)
        d /= d.sum(2, keepdims=True)
        d.reshape(-1)[np.arange(0, d.size, CLASSES) + self.class_of[np.maximum(target, 0)].ravel()] -= 1
        d *= (known / max(1, known.sum())).astype(np.float32)[:, :, None]
        flat = lambda x: x.reshape(-1, x.shape[-1])
        g = {"w2": flat(h).T @ flat(d), "b2": flat(d).sum(0)}
        dh = d @ p["w2"].T
        dh *= h > 0
        g |= {"w1": flat(f["z"]).T @ flat(dh), "b1": flat(dh).sum(0)}
        dz = dh @ p["w1"].T
        do = dz @ p["o"].T
        g["o"] = flat(f["o"]).T @ flat(dz)
        ds, dv = do @ f["v"].transpose(0, 2, 1), a.transpose(0, 2, 1) @ do
        ds -= (ds * a).sum(2, keepdims=True)
        ds *= a
        ds *= np.float32(DIM ** -0.5)
        dq, dk = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"]
        x = f["x"]
        g |= {"q": flat(x[:, STRIDE:]).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv)}
        dx = dk @ p["k"].T
        dx += dv @ p["v"].T
        dz += dq @ p["q"].T
        dx[:, STRIDE:] += dz
        dx[f["gone"]] = 0
        g["place"] = dx.sum(0)
        by_column = np.array(flat(dx).T, np.float64, order="C")
        for name, index, rows in (("class", f["c"].ravel(), CLASSES), ("row", f["row"].ravel(), ROWS)):
            g[name] = np.stack([np.bincount(index, weights=v, minlength=rows) for v in by_column], 1).astype(np.float32)
        return g


def _wide(rows: np.ndarray, last: float) -> np.ndarray:
    return np.concatenate([rows, np.full((len(rows), 1), last, np.float32)], 1)


def _clipped(x: np.ndarray) -> np.ndarray:
    """Hardly ever is there anything to clip, and to look for it takes less than to write all again."""
    return np.clip(x, -_CLIP, _CLIP, out=x) if x.size and max(x.max(), -x.min()) > _CLIP else x


def _weights(q: np.ndarray, xt: np.ndarray, causal: np.ndarray) -> np.ndarray:
    """exp of what each position gives the ones it sees, before it is divided by its sum."""
    e = _clipped(q @ xt[:, :DIM])
    np.exp(e, out=e)
    e *= causal
    return e


def _layers(o: np.ndarray, own: np.ndarray, far: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = o @ far
    z += own
    h = z @ w1
    np.maximum(h, 0, out=h)
    return z, h, h @ w2


class Scorer:
    """The forward pass of a trained model, with what depends on the id alone looked up in a table."""

    def __init__(self, model: AttentionModel):
        p = model.p
        self.model, self.none = model, len(model.class_of)
        self.near, self.far, self.w1 = model._products()
        self.x = np.zeros((self.none + 1, DIM + 1), np.float32)
        self.x[:-1] = _wide(p["class"][model.class_of] + p["row"][np.arange(self.none) & (ROWS - 1)], 1)
        self.place = _wide(p["place"], 0)
        self.prior = model.prior + p["b2"]
        self.ones = np.ones(CLASSES, np.float32)

    def attended(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the attention model's own probability of each target; any number where there is none."""
        model = self.model
        x = np.take(self.x, np.where(source >= 0, source, self.none), axis=0)
        x += self.place
        x[np.nonzero(source < 0)] = 0
        own = x[:, STRIDE:]
        o = _weights(own @ self.near, np.ascontiguousarray(x.transpose(0, 2, 1)), model.causal) @ x
        o /= np.maximum(o[:, :, DIM:], np.float32(1e-30))
        logits = _layers(o, own, self.far, self.w1, model.p["w2"])[2]
        logits += np.take(self.prior, model.class_of[np.maximum(source[:, STRIDE:], 0)], axis=0)
        logits = _clipped(logits)
        goal = np.maximum(target, 0)
        got = logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + model.class_of[goal].ravel()].astype(np.float64)
        np.exp(logits, out=logits)
        return got.reshape(goal.shape) + model.within[goal] - np.log(logits @ self.ones)

    def log_probabilities(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target, 0 where there is none."""
        before = np.maximum(source, 0)
        got = self.model.blended(
            before[:, STRIDE - 1: -1].ravel(), before[:, STRIDE:].ravel(), np.maximum(target, 0).ravel(), self.attended(source, target).ravel())
        return np.where(target >= 0, got.reshape(target.shape), 0.0)

    def texts(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text."""
        source, target, _ = blocks(ids, count, self.none - 1)
        if not len(source):
            return np.zeros(len(count))
        known = target >= 0
        log_p = np.concatenate([self.attended(source[a: a + _AT_ONCE], target[a: a + _AT_ONCE]) for a in range(0, len(source), _AT_ONCE)])[known]
        # The runs of all blocks are looked up together, in the order of the ids.
        got = self.model.blended(*(np.maximum(x, 0)[known] for x in (source[:, STRIDE - 1: -1], source[:, STRIDE:], target)), log_p)
        return np.bincount(np.repeat(np.arange(len(count)), count + 1), weights=got, minlength=len(count)) / np.log(10)


def id_classes(seen: np.ndarray, near: np.ndarray, seed: int = 9) -> np.ndarray:
    """Class of each id by k-means on its neighbours: ``near`` counts them by hash, before and after. An id weighs as often as it
    is seen; those seen under ``SELDOM`` times share one class."""
    out = np.full(len(seen), CLASSES - 1)
    often = np.flatnonzero(seen >= SELDOM)
    k = min(CLASSES - 1, len(often))
    if not k:
        return out
    v = np.log1p(near[often])
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
    rng = np.random.default_rng(seed)
    weight = seen[often] / seen[often].sum()
    centre = v[rng.choice(len(often), k, replace=False, p=weight)]
    for _ in range(10):
        own = (v @ centre.T - 0.5 * (centre ** 2).sum(1)).argmax(1)
        size = np.bincount(own, weights=weight, minlength=k)
        total = np.stack([np.bincount(own, weights=v[:, j] * weight, minlength=k) for j in range(v.shape[1])], 1)
        centre = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centre)
    out[often] = own
    return out


def _rows(docs: DataFrame, learn: Column) -> DataFrame:
    """key columns id and salt (which tells texts of one doc_id apart), text, and whether to learn from it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("salt"),
        text.alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))


def _summed(counts: DataFrame, size: int) -> np.ndarray:
    """n by key; at most ``size`` rows, which no data makes more, reach the driver."""
    got = counts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out


def _learned_ids(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: ids of all texts, number of ids of each, salts."""
    size = np.dtype(kind).itemsize
    for batch in batches:
        data, offsets = W.text_bytes(batch.column("ids"))
        salt = batch.column("salt").to_numpy()
        for lo, hi in W.slices(offsets, 1 << 20):
            yield data[offsets[lo]: offsets[hi]].view(kind).astype(np.int64), np.diff(offsets[lo: hi + 1]) // size, salt[lo:hi]


def _ended(ids: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    """An end, and all texts with an end after each."""
    out = np.full(len(ids) + len(count) + 1, end, np.int64)
    out[1 + np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    return out


def class_pairs(texts: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """How often one class follows another in all texts."""
    end, kind = len(class_of) - 1, _width(len(class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.zeros(CLASSES * CLASSES, np.int64)
        for ids, count, _ in _learned_ids(batches, kind):
            c = class_of[_ended(ids, count, end)]
            two += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        some = np.flatnonzero(two)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(two[some])], names=["key", "n"])

    return _summed(texts.mapInArrow(run, "key bigint, n bigint"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def run_keys(ended: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A number for each two neighbouring ids, (first * n + second), and for each three whose middle one leaves its word open,
    n * n + (first * n + second) * n + third."""
    n = len(inner)
    two = ended[:-1] * n + ended[1:]
    third = np.flatnonzero(inner[ended[1:-1]])
    return np.concatenate([two, (two[third] + n) * n + ended[third + 2]])


def _added(keys: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, with those of ``more`` put in."""
    some, times = np.unique(np.concatenate([keys[:0], *more]), return_counts=True)
    if not len(keys):
        return some, times
    at = np.searchsorted(keys, some)
    new = keys[np.minimum(at, len(keys) - 1)] != some
    n = n.copy()
    n[at[~new]] += times[~new]
    return np.insert(keys, at[new], some[new]), np.insert(n, at[new], times[new])


def run_counts(texts: DataFrame, inner: np.ndarray) -> DataFrame:
    """key, n of all runs of two and three ids of all texts, written."""
    n_ids = len(inner)
    kind = _width(n_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for ids, count, _ in _learned_ids(batches, kind):
            waiting.append(run_keys(_ended(ids, count, n_ids - 1), inner))
            if sum(map(len, waiting)) < _RUNS_AT_ONCE:
                continue
            (keys, n), waiting = _added(keys, n, waiting), []
            if len(keys) > _RUNS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                keys, n = keys[:0], n[:0]
        keys, n = _added(keys, n, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return materialize(texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "id-runs")


def _least_held(counted: DataFrame, most: int) -> tuple[int | None, bool]:
    """The smallest count that leaves at most ``most`` runs or words, none if every count leaves more; and whether others are left.
    Nothing but the counts' histogram reaches the driver."""
    level = F.floor(16 * F.log2("n"))  # at most 16 levels from one power of two to the next
    least = None
    total = 0
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("runs"), F.min("n").alias("n")).collect(), key=lambda r: -r.level):
        total += row.runs
        if total > most:
            return least, True
        least = row.n
    return least, False


def following(texts: DataFrame, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of two and three ids seen most over all texts, and their counts: up to ``FOLLOWERS``, those that are held."""
    counted = run_counts(texts, inner)
    held = counted.where(F.col("n") >= F.lit(_least_held(counted, FOLLOWERS)[0])).toArrow()
    return held.column("key").to_numpy(), held.column("n").to_numpy().astype(np.float64)


def learn_all_runs(model: AttentionModel, ids: np.ndarray, texts: DataFrame) -> DataFrame | None:
    """Teaches ``model`` the runs seen most. The others come back as a table (key, n, given), none if all are held."""
    counted = run_counts(texts, model.inner)
    least, more = _least_held(counted, FOLLOWERS)
    n = F.col("n")
    if not more:
        held = counted.where(n >= F.lit(least)).toArrow()
        model.learn_runs(ids, held.column("key").to_numpy(), held.column("n").to_numpy().astype(np.float64))
        return None
    two = F.col("key") < model.n_ids ** 2
    first = F.expr(f"key div {model.n_ids}")
    holds = (F.sum("n") - F.lit(DISCOUNT) * F.count("*")).alias("given")  # every n is 1 or more
    first_given = np.zeros(model.n_ids)
    got = counted.where(two).groupBy(first.alias("id")).agg(holds).toArrow()  # a row for an id at most
    first_given[got.column("id").to_numpy()] = got.column("given").to_numpy()
    goes_on = counted.where(~two).groupBy((first - model.n_ids).alias("key")).agg(holds)
    runs = counted.where(two).join(goes_on, "key", "left").select("key", "n", F.coalesce("given", F.lit(0.0)).alias("given"))
    runs = materialize(runs.unionByName(counted.where(~two).withColumn("given", F.lit(0.0))), "id-runs")
    held = runs.where(n >= F.lit(least)).toArrow()
    values = [held.column(c).to_numpy().astype(np.float64) for c in ("n", "given")]
    model.learn_runs(ids, held.column("key").to_numpy(), *values, first_given)
    return runs.where(n < F.lit(least)) if least is not None else runs


def runs_asked(texts: DataFrame, model: AttentionModel) -> DataFrame:
    """part, key of the runs of each part's texts that ``model`` does not hold, some of them repeated."""
    keys, inner, kind = model.keys, model.inner, _width(model.n_ids)
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            for a, b in zip(starts, np.append(starts[1:], len(part))):
                data, offsets = W.text_bytes(batch.column("ids").slice(a, b - a))
                for lo, hi in W.slices(offsets):
                    ids = data[offsets[lo]: offsets[hi]].view(kind).astype(np.int64)
                    asked = np.sort(run_keys(_ended(ids, np.diff(offsets[lo: hi + 1]) // size, len(inner) - 1), inner))
                    asked = asked[np.append(True, asked[1:] != asked[:-1])[: len(asked)]]
                    if len(keys):
                        asked = asked[keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] != asked]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), part[a])), pa.array(asked)], names=["part", "key"])

    return texts.select("part", "ids").mapInArrow(run, "part bigint, key bigint")


def _batches(
    batches: Iterator[pa.RecordBatch], n_ids: int, turn: int, passes: int, seen: list[int],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every block whose turn it is, ``passes`` times, in batches; ``seen`` gets their number."""
    rng, kind = np.random.default_rng(8 + turn), _width(n_ids)
    source, target = np.zeros((0, 2 * STRIDE), np.int64), np.zeros((0, STRIDE), np.int64)
    for ids, count, salt in _learned_ids(batches, kind):
        x, y, _ = blocks(ids, count, n_ids - 1, (salt + turn) % ROUNDS, ROUNDS)
        seen[0] += len(x)
        order = np.concatenate([rng.permutation(len(x)) for _ in range(passes)])
        source, target = np.concatenate([source, x[order]]), np.concatenate([target, y[order]])
        full = len(source) - len(source) % BATCH
        for a in range(0, full, BATCH):
            yield source[a: a + BATCH], target[a: a + BATCH]
        source, target = source[full:], target[full:]
    if len(source):
        yield source, target


def fitted(model: AttentionModel, texts: DataFrame, n_blocks: int) -> AttentionModel:
    """Fits the weights to all blocks of ``texts``, each in one of the rounds."""
    n_ids = len(model.class_of)
    passes = max(1, min(-(-DRAWS // max(1, n_blocks)), DRAWS // BATCH))
    texts = texts.coalesce(max(1, n_blocks // DRAWS))  # averages of tasks with a few steps each would hardly move

    def mean(rows: pa.Table) -> pa.Table:
        weight, part = rows.column("n").to_numpy(), rows.column("part").to_numpy()
        order = np.argsort(part)
        values = np.stack([np.frombuffer(rows.column("weights")[int(i)].as_py(), "<f4") for i in order])
        out = np.average(values, axis=0, weights=weight[order]).astype("<f4")
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "weights": pa.array([out.tobytes()], pa.binary())})

    for turn in range(ROUNDS if n_blocks else 0):
        rate = 0.01 * (1 - 0.9 * (turn + 0.5) / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], turn=turn, rate=rate) -> Iterator[pa.RecordBatch]:
            seen, flat = [0], model.packed()
            own = AttentionModel(model.class_of).unpack(flat)
            own.prior = model.prior
            flat = own.fit(_batches(batches, n_ids, turn, passes, seen), rate).packed()
            if seen[0]:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(_CHUNKS, part, np.int32)), pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array(np.full(_CHUNKS, seen[0])),
                    pa.array([x.astype("<f4").tobytes() for x in np.array_split(flat, _CHUNKS)], pa.binary())], names=["part", "chunk", "n", "weights"])

        got = texts.mapInArrow(run, "part int, chunk int, n bigint, weights binary").groupBy("chunk").applyInArrow(mean, "chunk int, weights binary").collect()
        if got:
            model.unpack(np.concatenate([np.frombuffer(r.weights, "<f4") for r in sorted(got, key=lambda r: r.chunk)]))
    return model


def trained(rows: DataFrame, path: str) -> tuple[AttentionModel, DataFrame, DataFrame | None]:
    """The model, the written table of encoded texts and counts, and the runs that the model does not hold, if any."""
    n_ids = word_encoder(path).n_ids + 1
    inner = np.append(word_encoder(path).inner, False)
    encoded = _encoded_table(rows, path, n_ids)
    # As many rows as there are ids, hashed neighbours of ids and pairs of classes reach the driver.
    counts = _summed(encoded.where(F.col("kind") == _COUNT), n_ids + 1)
    near = _summed(encoded.where(F.col("kind") == _NEIGHBOUR), n_ids * 2 * NEAR).reshape(n_ids, 2 * NEAR)
    model = AttentionModel(id_classes(counts[:n_ids], near), inner)
    texts = encoded.where((F.col("kind") == _TEXT) & F.col("learn")).select("salt", "ids")
    model.learn_counts(counts[:n_ids], class_pairs(texts, model.class_of))
    model = fitted(model, texts, int(counts[n_ids]))
    return model, encoded, learn_all_runs(model, counts[:n_ids], texts)


def train(rows: DataFrame, path: str) -> tuple[AttentionModel, DataFrame]:
    """The model, and the written table of encoded texts and counts."""
    return trained(rows, path)[:2]


END_WORD = -1


def _width(n_ids: int) -> str:
    """Type of the ids written."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def _encoded_table(rows: DataFrame, path: str, n_ids: int) -> DataFrame:
    """id, salt, learn, ids and part (key) of every text (kind 0), and of the texts to learn from, in parts, key and n: of words (kind 1), of
    ids and, behind them, all blocks (kind 2), and of ids with the hash of the id before or after (kind 3)."""
    schema = pa.schema([
        ("kind", pa.int32()), ("id", pa.int64()), ("salt", pa.int64()), ("learn", pa.bool_()), ("ids", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
    slot = (W.mix(np.arange(n_ids, dtype=np.uint64)) % np.uint64(NEAR)).astype(np.int64)

    def of(n_rows: int, kind: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n_rows, kind, np.int32)), *[columns.get(f.name, pa.nulls(n_rows, f.type)) for f in list(schema)[1:]]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = word_encoder(path), _width(n_ids)
        one, near = np.zeros(n_ids + 1, np.int64), np.zeros(n_ids * 2 * NEAR, np.int64)
        number = TaskContext.get().partitionId() << 32  # a part is one slice of one task
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(offsets):
                part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                doc, starts, ends = W.spans(part, at, W.NOT_SPACE)
                word = W.hashes(part, starts, ends)
                ids, count = encoder.encode(part, at, (doc, starts, ends, word))
                flat, cut = ids.astype(kind).tobytes(), np.concatenate(([0], np.cumsum(count))) * np.dtype(kind).itemsize
                yield of(hi - lo, _TEXT, id=batch.column("id").slice(lo, hi - lo), salt=batch.column("salt").slice(lo, hi - lo),
                         learn=batch.column("learn").slice(lo, hi - lo), ids=pa.array([flat[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()), key=pa.array(np.full(hi - lo, number)))
                number += 1
                taught = learn[lo:hi].astype(bool)
                if not taught.any():
                    continue
                word, n = np.unique(np.append(word[taught[doc]].view(np.int64), np.full(int(taught.sum()), END_WORD)), return_counts=True)
                yield of(len(word), _WORD, key=pa.array(word), n=pa.array(n))
                ids, count = ids[np.repeat(taught, count)], count[taught]
                ended = _ended(ids, count, n_ids - 1)
                one[:-1] += np.bincount(ended[1:], minlength=n_ids)
                one[-1] += int((count // STRIDE + 1).sum())
                np.add.at(near, ended[1:] * 2 * NEAR + slot[ended[:-1]], 1)
                np.add.at(near, ended[:-1] * 2 * NEAR + NEAR + slot[ended[1:]], 1)
        for what, sums in ((_COUNT, one), (_NEIGHBOUR, near)):
            some = np.flatnonzero(sums)
            for a in range(0, len(some), 1 << 18):
                yield of(len(some[a: a + (1 << 18)]), what, key=pa.array(some[a: a + (1 << 18)]), n=pa.array(sums[some[a: a + (1 << 18)]]))

    df = rows.select("id", "salt", "text", "learn").mapInArrow(run, "kind int, id bigint, salt bigint, learn boolean, ids binary, key bigint, n bigint")
    out = scratch_path(df.sparkSession, "encoded")
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: text and word of every word; the end is a word of its own."""
    data, offsets = W.text_bytes(batch.column("text"))
    for lo, hi in W.slices(offsets):
        part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        doc, starts, ends = W.spans(part, at, W.NOT_SPACE)
        word = W.hashes(part, starts, ends).view(np.int64)
        yield lo, hi, np.concatenate([doc, np.arange(hi - lo)]), np.concatenate([word, np.full(hi - lo, END_WORD)])


def word_uses(rows: DataFrame, word: np.ndarray, c: np.ndarray, others: bool) -> DataFrame:
    """A row without a word for each text, with its number of words n and, of the held words (sorted, with their counts), how many are
    known (k) and the sum of logs (s). With ``others``, a row for each different word of a text that is not held, and how often it is there."""
    known, log = np.append(c > 0, False), np.append(np.log10(c + 1.0), 0.0)
    schema = pa.schema([("id", pa.int64()), ("salt", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, doc, used in _words(batch):
                different, inverse = np.unique(used, return_inverse=True)
                at = np.minimum(np.searchsorted(word, different), max(len(word) - 1, 0))
                at = np.where(word[at] == different, at, len(word)) if len(word) else np.zeros(len(different), np.int64)
                total = lambda v: np.bincount(doc, weights=v, minlength=hi - lo)
                number = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), batch.column("salt").slice(lo, hi - lo), pa.nulls(hi - lo, pa.int64()), pa.array(number),
                    pa.array(total(known[at][inverse]).astype(np.int64)), pa.array(total(log[at][inverse]))], schema=schema)
                left = np.flatnonzero(at[inverse] == len(word)) if others else []
                if len(left):
                    both, n = np.unique(doc[left] * len(different) + inverse[left], return_counts=True)
                    take = pa.array(both // len(different) + lo)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(take), batch.column("salt").take(take), pa.array(different[both % len(different)]), pa.array(n),
                        pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64())], schema=schema)

    return rows.select("id", "salt", "text").mapInArrow(run, "id bigint, salt bigint, word bigint, n bigint, k bigint, s double")


def base_scores(rows: DataFrame, encoded: DataFrame) -> DataFrame:
    """id, salt, n_tokens, n_known, train_tokens, base_score of each different (id, salt); copies are divided out."""
    learned = encoded.where(F.col("kind") == _WORD).groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"))
    learned = materialize(learned, "word-counts")
    total, distinct = learned.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, others = _least_held(learned, HELD_WORDS)
    held = learned.where(F.col("n") >= F.lit(least)).toArrow()
    word, n = held.column("word").to_numpy(), held.column("n").to_numpy()
    order = np.argsort(word)
    used = word_uses(rows, word[order], n[order], others)
    texts = F.lit(1).alias("copies")
    if others:
        used = materialize(used, "word-uses")
        c = F.coalesce("c", F.lit(0))
        met = used.where(F.col("word").isNotNull()).select("id", "salt", "word", "n").join(
            # One row of two numbers per distinct word: its share in a partition fits in a hash table, and no use is sorted.
            learned.select("word", F.col("n").alias("c")).hint("shuffle_hash"), "word", "left").select(
            "id", "salt", F.lit(0).cast("bigint").alias("n"), F.when(c > 0, F.col("n")).otherwise(0).alias("k"),
            (F.col("n") * F.log10(c + 1.0)).alias("s"), F.lit(0).alias("copies"))
        used = used.where(F.col("word").isNull()).select("id", "salt", "n", "k", "s", texts).unionByName(met)
    else:
        used = used.select("id", "salt", "n", "k", "s", texts)
    sums = used.groupBy("id", "salt").agg(*[F.sum(x).alias(x) for x in ("n", "k", "s", "copies")])
    return sums.select(
        "id", "salt", (F.col("n") / F.col("copies")).cast("bigint").alias("n_tokens"), (F.col("k") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        ((F.col("s") - F.col("n") * F.log10(F.lit(float(total + distinct + 1)))) / F.col("copies")).alias("base_score"))


def score(docs: DataFrame, learn: Column, path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. ``learn`` says which rows may be learned from."""
    rows = _rows(docs, learn)
    model, encoded, others = trained(rows, path)

    def scores(scorer: Scorer, ids: pa.Array) -> pa.Array:
        kind = _width(len(model.class_of))
        size = np.dtype(kind).itemsize
        different = ids.dictionary_encode()  # equal texts are scored once
        data, offsets = W.text_bytes(different.dictionary)
        parts = [
            scorer.texts(data[offsets[lo]: offsets[hi]].view(kind).astype(np.int64), np.diff(offsets[lo: hi + 1]) // size)
            for lo, hi in W.slices(offsets, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64()).take(different.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("salt"), scores(scorer, batch.column("ids"))], names=["id", "salt", "score"])

    def run_part(texts: pa.Table, found: pa.Table) -> pa.Table:
        model.learn_others(*[found.column(c).to_numpy() for c in ("key", "n", "given")])
        got = scores(Scorer(model), texts.column("ids").combine_chunks())
        return pa.table({"id": texts.column("id"), "salt": texts.column("salt"), "score": got})

    texts = encoded.where(F.col("kind") == _TEXT).select("id", "salt", "ids", F.col("key").alias("part"))
    schema = "id bigint, salt bigint, score double"
    if others is None:
        scored = texts.select("id", "salt", "ids").mapInArrow(run, schema)
    else:
        found = runs_asked(texts, model).join(others, "key").select("part", "key", F.col("n").cast("double").alias("n"), "given")
        scored = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run_part, schema)
    scored = materialize(scored, "scores")
    return scored.join(base_scores(rows, encoded), ["id", "salt"]).select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

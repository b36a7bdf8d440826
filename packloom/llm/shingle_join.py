"""Jaccard self-join of documents on word shingles by PartEnum signatures.

Sets and nodes. A document's set holds the 64-bit hashes of its distinct shingles of ``width`` words ([^\\x20\\x09-\\x0D]+,
A-Z lowered); with fewer words, of the whole sequence; without words it is empty and links with nothing. Documents
with equal sets are one node, so exact copies are one from the start. Rows that share a doc_id count as one document
and belong together. Rows whose doc_id is null are returned with a null component and link with nothing; a
null text counts as empty. An empty table gives an empty result; columns other than doc_id and text are not read.

Signatures. Sizes are cut into bands of ratio 1 / similarity, so that linked sets lie in one band or in two
neighbours. Instance j serves the pairs whose smaller band is j: sets linked there differ in at most
k_j = floor(r_j (1 - s) / s) shingles, r_j being the band's largest size. A set takes part in the instances of
its own band and of the one below.

- k_j <= 3: the domain falls into k_j + 3 parts; k_j + 3 choose 3 subsets of three parts are enumerated. Linked
  sets agree on three parts at least.
- larger k_j: first-level parts, a fifth more than k_j + 1, so that linked sets agree on m_j + 1 of them at
  least; each part is one signature. A set with at most m_j empty parts skips those: one of the agreeing parts
  is not empty. Skipping them keeps unlike documents from meeting in "both have nothing here".
- a set with more empty parts, or with an empty subset in the first case, also gives each of its shingles as
  a signature; two such sets that are linked share one.

So every linked pair of different sets shares a signature. Buckets of two or more nodes are kept (a hot
signature costs time in proportion to its rows and no memory). A node that shares fewer signatures in an instance
than any linked pair must, m_j + 1 less its empty parts, is left out. The rest have their sets fetched.

Links. In rounds, as long as these help, every node of an unresolved bucket is compared with one leader, the one with which it
shares most signatures; verified links merge components, and buckets within one component are done. In what is left the
nodes of a bucket meet, in blocks, by parity sketches, an exact lower bound of the difference. First, again as long as it helps,
each node is tested only against the nearest one of another component: a dense group falls together by a row for each
node. At last all pairs between different components whose sketches do not rule a link out are tested against the sets.
No link between components is lost; links inside a component are not enumerated.
"""
from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.llm.components import merged
from packloom.session import materialize, scratch_path

SKETCH_BITS = 1024  # of a set of up to 512 shingles; larger sets have two to four bits a shingle
BRIEF_BITS = 256  # the least of a sketch for small buckets
FILTER_WORDS = 1 << 18
BLOCK, SMALL = 2048, 64
NEED_BITS = 16  # of the one number that goes through the shuffle of all signatures; the other 48 are the signature's
_U = np.uint64
_WEIGHTS = W.mix(np.arange(101, 133, dtype=_U)) | _U(1)


class Bands:
    """Size bands and the parts of the domain for each instance."""

    def __init__(self, similarity: Fraction):
        self.s = similarity
        self.right = [0]

    def _grow(self, size: int) -> None:
        while self.right[-1] < size:
            left = self.right[-1] + 1
            self.right.append(int(left / self.s))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max()))
        return np.searchsorted(self.right, sizes, "left")

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def instance(self, j: int) -> tuple[int, int, int]:
        """(k, parts, m): parts that may be empty and skipped."""
        k = int(self.right[j] * (1 - self.s) / self.s)
        if k <= 3:
            return k, k + 3, 0
        m = -(-(k + 1) // 5)
        return k, k + 1 + m, m


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of each text, in this order."""
    doc, starts, ends = W.spans(data, offsets, W.NOT_SPACE)
    h = W.hashes(data, starts, ends)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1:]) if len(doc) >= width else np.zeros(0, np.int64)
    code = np.zeros(len(at), _U)
    for j in range(width):
        code += h[at + j] * _WEIGHTS[j]
    short = np.flatnonzero((n > 0) & (n < width))
    rest = n[short].astype(_U) * _U(0x5851F42D4C957F2D)
    for j in range(width - 1):
        has = n[short] > j
        rest[has] += h[first[short[has]] + j] * _WEIGHTS[j]
    owner, code = np.concatenate([doc[at], short]), W.mix(np.concatenate([code, rest]))
    order = np.argsort(owner, kind="stable")
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    cuts = np.flatnonzero(np.append(owner[:1] == owner[:1], owner[1:] != owner[:-1]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist()):
        code[a:b].sort()  # text by text, which is faster than by two keys
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], code[new]


def _sums(slot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit values per slot, modulo 2**64."""
    high = np.bincount(slot, weights=(values >> _U(32)).astype(float), minlength=n).astype(_U)
    low = np.bincount(slot, weights=(values & _U(0xFFFFFFFF)).astype(float), minlength=n).astype(_U)
    return (high << _U(32)) + low


def _parts(code: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ((((code >> _U(32)) * parts.astype(_U))) >> _U(32)).astype(np.int64)


def node_ids(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, node) of each set."""
    size = np.bincount(owner, minlength=n)
    return size, W.mix(_sums(owner, W.mix(code ^ _U(0xA5A5A5A5)), n) + size.astype(_U)).view(np.int64)


def signatures(owner: np.ndarray, code: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, signature, need) of all sets; empty sets have none. ``need`` is twice the number of
    signatures that a linked set shares at least within this instance, plus 1 for the instance of the band below."""
    out_doc, out_sig, out_need = [], [], []
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    band = np.zeros(len(size), np.int64)
    band[some] = bands.of(size[some])
    values = W.mix(code + _U(0x1234567))
    for below in (0, 1):
        inst = band - below
        ok = inst > 0
        shape = {j: bands.instance(int(j)) for j in np.unique(inst[ok])}
        k, parts, m = (np.array([shape[j][c] if j > 0 else 0 for j in inst]) for c in range(3))
        mine = np.flatnonzero(ok[owner])
        base = np.cumsum(np.where(ok, parts, 0)) - np.where(ok, parts, 0)
        slots = int(np.where(ok, parts, 0).sum())
        slot = base[owner[mine]] + _parts(code[mine], parts[owner[mine]])
        sums, counts = _sums(slot, values[mine], slots), np.bincount(slot, minlength=slots)
        doc_of = np.repeat(np.arange(len(size)), np.where(ok, parts, 0))
        part_of = np.arange(slots) - base[doc_of]
        tag = W.mix(inst.astype(_U) + _U(1 << 20) )
        large = (k > 3)[doc_of]
        use = np.flatnonzero(large & (counts > 0))
        empty = np.bincount(doc_of[large & (counts == 0)], minlength=len(size))
        need = 2 * np.where(k > 3, np.maximum(m + 1 - empty, 1), 1) + below
        out_doc.append(doc_of[use])
        out_sig.append(W.mix(sums[use] + tag[doc_of[use]] + part_of[use].astype(_U) * _U(0x9E3779B97F4A7C15)))
        thin = ok & (k > 3) & (empty > m)
        for kk in range(4):
            docs = np.flatnonzero(ok & (k == kk))
            if not len(docs):
                continue
            grid = base[docs][:, None] + np.arange(kk + 3)
            for c, subset in enumerate(itertools.combinations(range(kk + 3), 3)):
                total, held = sums[grid[:, subset]].sum(1), counts[grid[:, subset]].sum(1)
                out_doc.append(docs[held > 0])
                out_sig.append(W.mix(total + tag[docs] + _U((c + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))[held > 0])
                thin[docs[held == 0]] = True
        each = np.flatnonzero(thin[owner])
        out_doc.append(owner[each])
        out_sig.append(W.mix(code[each] ^ tag[owner[each]] ^ _U(0x77777777)))
        out_need += [need[d] for d in out_doc[len(out_need):]]
    return np.concatenate(out_doc), np.concatenate(out_sig).view(np.int64), np.concatenate(out_need).astype(np.int32)


def parity(owner: np.ndarray, code: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A sketch of each set, as long as a power of two: each shingle flips one bit, so two sketches of one length
    differ in at most as many bits as their sets in shingles. The xor of its halves is the sketch of half the length."""
    bits = np.maximum(SKETCH_BITS, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    bit = (W.mix(code + _U(99)) & (bits[owner] - 1).astype(_U)).astype(np.int64)
    odd = np.bincount((ends - bits)[owner] + bit, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a // 8: b // 8] for a, b in zip(ends - bits, ends)]


def _halved(sketch: bytes, words: int) -> np.ndarray:
    out = np.frombuffer(sketch, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2:]
    return out


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ at the length of the shorter."""
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(_halved(x, words) ^ _halved(y, words)).sum())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = W.text_bytes(batch.column("text"))
    for lo, hi in W.slices(offsets):
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]


def document_nodes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _texts(batch):
                size, node = node_ids(*shingles(data, offsets, width), hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(size), pa.array(node, mask=size == 0)], names=["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint")


def signature_rows(docs: DataFrame, width: int, similarity: Fraction, owned: DataFrame | None = None) -> DataFrame:
    """sig, node of every set; copies that follow each other in a task give rows once. With ``owned``, the node of each document,
    only one document of each node, and few others, are cut into shingles."""
    wanted = None if owned is None else _first_documents(owned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, recent = Bands(similarity), np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in _texts(batch if wanted is None else _wanted(batch, wanted)):
                owner, code = shingles(data, offsets, width)
                size, node = node_ids(owner, code, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= ~np.isin(node, recent)
                recent = np.concatenate([recent[-100_000:], node[fresh]])
                keep = fresh[owner]
                doc, sig, need = signatures(owner[keep], code[keep], np.where(fresh, size, 0), bands)
                for a in range(0, len(sig), 1 << 17):
                    b = a + (1 << 17)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[a:b]), pa.array(node[doc[a:b]]), pa.array(need[a:b])], names=["sig", "node", "need"])

    texts = docs if wanted is None else docs.select(F.xxhash64("doc_id").alias("key"), "text")
    return texts.mapInArrow(run, "sig bigint, node bigint, need int")


def buckets(rows: DataFrame) -> DataFrame:
    """The (sig, node) rows of signatures with two nodes or more, each once. Spark sorts the rows, spilling
    where it must; a task then holds one batch and one row of the signature it is in.

    The shuffle, which is the largest of all, carries the low bits of a signature and its need as one number. Signatures that
    differ in other bits only share a bucket; a need too large for its bits is the largest of its kind. Both let more nodes
    through, none less."""
    most = (1 << NEED_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None  # the only node so far of the last signature
        given = None  # the last signature, if it has two
        last = None  # the last row
        for batch in batches:
            if not len(batch):
                continue
            key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
            sig, need = key >> NEED_BITS, (key & most).astype(np.int32)
            columns = [sig, node, need]
            again = np.append(last == (sig[0], node[0]), (sig[1:] == sig[:-1]) & (node[1:] == node[:-1]))
            last = (sig[-1], node[-1])
            columns = [c[~again] for c in columns]
            if waiting is not None:
                columns = [np.concatenate(c) for c in zip(waiting, columns)]
            sig, node, _ = columns
            if not len(sig):
                continue
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            two = np.minimum.reduceat(node, starts) != np.maximum.reduceat(node, starts)
            two[0] |= given is not None and given == sig[0]
            shared = np.repeat(two, np.diff(np.append(starts, len(sig))))
            at = starts[-1]
            given, waiting = (sig[-1], None) if two[-1] else (None, [c[at: at + 1] for c in columns])
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in columns], names=["sig", "node", "need"])

    need = F.least(F.col("need"), F.lit(most - 1) + F.col("need") % 2).cast("bigint")
    packed = rows.select(F.shiftleft("sig", NEED_BITS).bitwiseOR(need).alias("key"), "node")
    packed = packed.repartition(F.shiftright("key", NEED_BITS)).sortWithinPartitions("key", "node")
    return packed.mapInArrow(run, "sig bigint, node bigint, need int")


def enough(rows: DataFrame) -> DataFrame:
    """Rows of nodes that share as many signatures, with anyone, as a link takes, with the size m of their bucket; what is
    left alone in its bucket goes too."""
    per = rows.groupBy("node", "need").agg(F.count("*").alias("c")).where(F.col("c") >= F.floor(F.col("need") / 2)).select("node", "need")
    kept = rows.join(per, ["node", "need"]).select("sig", "node")
    return kept.join(kept.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "sig")


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes ``node``; its FILTER_WORDS words are all that reaches the driver."""
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    place = F.expr(f"shiftrightunsigned(node, 6) % {FILTER_WORDS}")
    rows = nodes.groupBy(place.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _first_documents(owned: DataFrame) -> np.ndarray:
    """A filter of the hashed ids of one document of each node."""
    chosen = owned.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return _filter_bits(chosen.select(F.xxhash64("doc_id").alias("node")))


def _wanted(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    """The rows whose ``key`` the filter holds, and few others."""
    key = batch.column("key").to_numpy()
    found = (wanted[((key.view(_U) >> _U(6)) % _U(FILTER_WORDS)).astype(np.int64)] >> (key & 63)) & 1
    return batch.filter(pa.array(found.astype(bool)))


def node_sets(docs: DataFrame, nodes: DataFrame, owned: DataFrame, width: int) -> DataFrame:
    """node, n, sketch, codes (uint64, sorted) of the nodes, and of few others. ``owned`` has the node of each document: one document
    of each node is cut into shingles again, the rest of the texts is passed over."""
    wanted = _first_documents(owned.join(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in _texts(_wanted(batch, wanted)):
                owner, code = shingles(data, offsets, width)
                size, node = node_ids(owner, code, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= (size > 0) & ~np.isin(node, recent)
                recent = np.concatenate([recent[-100_000:], node[fresh]])
                docs_ = np.flatnonzero(fresh)
                for a in range(0, len(docs_), 512):
                    some = docs_[a: a + 512]
                    rank = np.full(hi - lo, -1)
                    rank[some] = np.arange(len(some))
                    keep = rank[owner] >= 0
                    sketch = parity(rank[owner[keep]], code[keep], size[some])
                    cuts = np.split(code[keep], np.cumsum(size[some])[:-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(node[some]), pa.array(size[some]), pa.array(sketch, pa.binary()),
                        pa.array([c.tobytes() for c in cuts], pa.binary())], names=["node", "n", "sketch", "codes"])

    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(run, "node bigint, n bigint, sketch binary, codes binary")
    return rows.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("codes").alias("codes"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, tested exactly."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(down * shared >= up * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("codes").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("y"))
    lengths = (F.col("na") * down >= F.col("nb") * up) & (F.col("nb") * down >= F.col("na") * up)
    return pairs.join(x, "a").join(y, "b").where(lengths).select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """A table in the shared folder, bucketed by ``key``: joins on it shuffle the other side only."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _unresolved(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (sig, node, comp) of buckets that still hold two components."""
    known = rows.join(comps, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = known.groupBy("sig").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("m")).where("p <> q").select("sig", "m")
    return known.join(open_, "sig")


def _leader_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each node with the leader, of another component, with which it shares most buckets."""
    rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("leader"), F.col("comp").alias("of"))
    leaders = rows.groupBy("sig").agg(F.min(rank).alias("l")).select("sig", "l.leader", "l.of")
    shared = rows.join(leaders, "sig").where("comp <> of").groupBy("node", "leader").agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", F.col("leader").alias("leader"))).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.leader").alias("b"))


def _bits(sides: list[pd.Series]) -> list[np.ndarray]:
    """The signatures of each row as bits, for those that occur on two rows or more."""
    held = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
    known, times = np.unique(np.concatenate(held), return_counts=True)
    known = known[times > 1]
    out = []
    for side, sigs in zip(sides, held):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(known, sigs)
        ok = np.isin(sigs, known)
        bits = np.zeros((len(side), len(known) // 64 + 1), _U)
        np.bitwise_or.at(bits, (row[ok], at[ok] >> 6), _U(1) << (at[ok] & 63).astype(_U))
        out.append(bits)
    return out


def _with_brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a shorter sketch, of one to two bits a shingle, which goes to every small bucket of a node."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        words = np.maximum(BRIEF_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)) // 64
        brief = [_halved(x, w).tobytes() for x, w in zip(batch.column("sketch").to_pylist(), words)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(brief, pa.binary())], names=["node", "n", "sketch", "brief"])


def _small_pairs(rows: DataFrame, similarity: Fraction, nearest: bool = False) -> DataFrame:
    """(a, b, d), some repeated: pairs of different components of buckets of up to ``SMALL`` nodes whose sketches do not rule a
    link out, and the share in which these differ. Each node brings its sketch to its buckets, and only such pairs leave the task, which
    holds one batch and one bucket. ``nearest``: only the nearest b of each a in the task's rows."""
    up, down = similarity.numerator, similarity.denominator
    names = ["sig", "node", "comp", "n", "sketch"]

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        sig, node, comp, n = (table.column(c).to_numpy() for c in names[:4])
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(starts, len(sig)))
        # Every row with each row after it in its bucket.
        left = np.repeat(starts + size, size) - np.arange(len(sig)) - 1
        i = np.repeat(np.arange(len(sig)), left)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        ok = (comp[i] != comp[j]) & (n[i] * down >= n[j] * up) & (n[j] * down >= n[i] * up)
        i, j = i[ok], j[ok]
        once = np.unique(np.stack([node[i], node[j]], 1), axis=0, return_index=True)[1]
        i, j = i[once], j[once]
        sketch = table.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in sketch], np.int64)
        shorter, apart = np.minimum(words[i], words[j]), np.zeros(len(i), np.int64)
        for w in np.unique(shorter):
            at = np.flatnonzero(shorter == w)
            used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            s = np.array([_halved(sketch[k], int(w)) for k in used], np.uint64).reshape(len(used), int(w))
            for lo in range(0, len(at), 1 << 14):
                some = at[lo: lo + (1 << 14)]
                apart[some] = np.bitwise_count(s[place[lo: lo + len(some)]] ^ s[place[len(at) + lo: len(at) + lo + len(some)]]).sum(1)
        total = n[i] + n[j]
        keep = np.flatnonzero(apart * (down + up) <= total * (down - up))
        a, b, d = node[i[keep]], node[j[keep]], apart[keep] / total[keep]
        if nearest:
            order = np.lexsort((b, d, a))
            first = order[np.unique(a[order], return_index=True)[1]]
            a, b, d = a[first], b[first], d[first]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the bucket that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            sig = table.column("sig").to_numpy()
            at = int(np.searchsorted(sig, sig[-1]))
            if at:
                yield pairs_of(table.slice(0, at))
            waiting = table.slice(at)
        if waiting is not None:
            yield pairs_of(waiting)

    return rows.select(names).repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a bigint, b bigint, d double")


def _cross_pairs(rows: DataFrame, sets: DataFrame, similarity: Fraction, nearest: bool = False) -> DataFrame:
    """Pairs of different components of a bucket whose sketches do not rule a link out; blocks of a bucket
    meet each other, so no task holds a whole one. Nodes that meet in several large buckets are compared in the
    one with the smallest signature: each row brings the smaller signatures of its node. ``nearest``: of these pairs (a, b), a < b,
    only that of the nearest b for each a."""
    up, down = similarity.numerator, similarity.denominator

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["l"]], pdf[pdf["r"]]
        met = _bits([left["lower"], right["lower"]])
        words = min(map(len, pdf["sketch"])) // 8
        s = [np.array([_halved(x, words) for x in t["sketch"]], np.uint64).reshape(len(t), words) for t in (left, right)]
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        na, nb, ca, cb = left["n"].to_numpy(), right["n"].to_numpy(), left["comp"].to_numpy(), right["comp"].to_numpy()
        out = []
        for i in range(len(a)):
            j = np.flatnonzero((a[i] < b) & (ca[i] != cb) & (na[i] * down >= nb * up) & (nb * down >= na[i] * up))
            j = j[~(met[0][i] & met[1][j]).any(1)]
            apart = np.bitwise_count(s[0][i] ^ s[1][j]).sum(1)
            total = na[i] + nb[j]
            keep = np.flatnonzero(apart * (down + up) <= total * (down - up))
            d = apart[keep] / total[keep]
            if nearest and len(keep):
                first = np.lexsort((b[j[keep]], d))[:1]
                keep, d = keep[first], d[first]
            out.append((np.full(len(keep), a[i]), b[j[keep]], d))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip("abd", columns)))

    sketches = materialize(sets.select("node", "n", "sketch").mapInArrow(_with_brief, "node bigint, n bigint, sketch binary, brief binary"), "sketches")
    small = rows.where(F.col("m") <= SMALL).select("sig", "node", "comp").join(sketches.select("node", "n", F.col("brief").alias("sketch")), "node")
    sketches = sketches.drop("brief")
    near = _small_pairs(small, similarity, nearest)
    rows = rows.where(F.col("m") > SMALL)
    blocks = F.ceil(F.col("m") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    mine = rows.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    lower = F.slice("sigs", F.lit(1), (F.array_position("sigs", F.col("sig")) - 1).cast("int"))
    sized = rows.join(sketches, "node").join(mine, "node").withColumn("own", own).withColumn("lower", lower)
    # Block i meets block j for all i, j; a pair of nodes is taken where the smaller one is on the left.
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    own, other = F.col("own"), F.col("other")
    left = F.struct(own.alias("i"), other.alias("j"), F.lit(True).alias("l"), (own == other).alias("r"))
    right = F.struct(other.alias("i"), own.alias("j"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    # Both sides come from one pass, so that the sketches are joined once.
    sides = F.when(own == other, F.array(left)).otherwise(F.array(left, right))
    spread = spread.withColumn("side", F.explode(sides)).select("sig", "side.*", "node", "comp", "n", "sketch", "lower")
    pairs = near.unionByName(spread.groupBy("sig", "i", "j").applyInPandas(run, "a bigint, b bigint, d double"))
    if nearest:
        return pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", "best.b")
    return pairs.select("a", "b").distinct()


def node_classes(docs: DataFrame, owned: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(node, comp) of all nodes with signatures in common with others: each node's class by verified links."""
    rows = materialize(buckets(signature_rows(docs, width, similarity, owned)), "buckets")
    rows = materialize(enough(rows), "buckets")
    nodes = materialize(rows.select("node").distinct(), "nodes")
    sets = bucketed(node_sets(docs, nodes, owned, width), "node", "sets")
    comps = nodes.select("node", F.col("node").alias("comp"))
    kinds = [
        lambda rows, turn: _leader_pairs(rows, turn),  # leaders change each round
        lambda rows, turn: _cross_pairs(rows, sets, similarity, nearest=True),
        lambda rows, turn: _cross_pairs(rows, sets, similarity),
    ]
    kind, turn, before = 0, 0, None
    while True:
        # At first every node is a component of its own, and every bucket open.
        open_ = rows.select("sig", "node", F.col("node").alias("comp"), "m") if before is None else materialize(_unresolved(rows, comps), "open")
        n = open_.count()
        if not n:
            break
        # Each kind of round goes on as long as it closes a quarter of what is open.
        if before is not None and 4 * n > 3 * before:
            kind += 1
        comps = merged(comps, materialize(verified(kinds[kind](open_, turn), sets, similarity), "found"))
        if kind == 2:
            break
        rows, turn, before = open_.select("sig", "node"), turn + 1, n
    return comps


def classes(docs: DataFrame, similarity: Fraction = Fraction(4, 5), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per document."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    owned = materialize(document_nodes(docs, width), "document-nodes")
    comps = node_classes(docs.where("doc_id is not null"), owned, width, similarity)
    some = owned.where("node is not null and doc_id is not null")
    # Rows of one doc_id belong together, whatever their texts.
    first = some.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    if not first.isEmpty():
        again = some.join(first.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
        comps = merged(comps, again)
    smallest = some.groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left").select(
        "node", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = materialize(smallest, "smallest")
    of_comp = smallest.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = smallest.join(of_comp, "comp").select("node", "component_id")
    lone: Column = F.col("doc_id")
    return owned.join(by_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", lone)).alias("component_id"))

"""Near copies among embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of
largest magnitude with its sign. Two hashes make a bucket, and ``TABLES`` tables are kept. A vector stands
in its own bucket and probes the next ones too (the best ``PROBES`` coordinates of each hash). Whatever meets there, with equal
non-null labels and equal length, is compared by cosine in double precision; only pairs at ``cosine`` or more link.

A bucket is cut into blocks of about ``BLOCK`` vectors, and blocks meet in pairs, so that no task holds a whole
bucket. A task counts links and returns one row per vector; pairs are not written out. A pair that meets in several
tables or buckets is counted in the first.

Vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link with
nothing. One row per distinct vec_id is returned; rows that share a vec_id are one vector with several positions and do not
link with each other. A null vec_id gets a null component and is not kept. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.components import components
from packloom.session import materialize

TABLES, PROBES, BLOCK = 8, 2, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def polytope(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """(rows, probes) signed coordinates of largest magnitude, best first."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    v = np.zeros((len(x), d))
    v[:, : x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64([seed, d]))
    for _ in range(3):
        v = hadamard(v * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
    top = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :probes]
    return top * 2 + (np.take_along_axis(v, top, 1) < 0)


def bucket_codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes * probes) buckets; the first is the vector's own."""
    d = 2 << max(1, (x.shape[1] - 1).bit_length())
    out = []
    for t in range(tables):
        a, b = polytope(x, 2 * t, probes), polytope(x, 2 * t + 1, probes)
        out.append((a[:, :, None] * d + b[:, None, :]).reshape(len(x), -1))
    return np.stack(out, 1).astype(np.int32)


def _entries(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(size) - size
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                x = flat[at[rows][:, None] + np.arange(d)].astype(np.float64)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                rows, x, norm = rows[ok], x[ok], norm[ok]
                for a in range(0, len(rows), 256):
                    r, u = rows[a: a + 256], x[a: a + 256] / norm[a: a + 256, None]
                    codes = bucket_codes(u)
                    k = codes.shape[2]
                    rep = np.repeat(np.arange(len(r)), TABLES * k)
                    pos = np.tile(np.arange(TABLES * k), len(r))
                    take = pa.array(r[rep])
                    units, marks = pa.array([v.tobytes() for v in u], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        batch.column("label").take(take), pa.array(np.full(len(rep), d, np.int32)), pa.array((pos // k).astype(np.int32)),
                        pa.array(codes.reshape(-1)), batch.column("vec_id").take(take), pa.array(pos % k == 0),
                        units.take(pa.array(rep)), marks.take(pa.array(rep)),
                    ], names=["label", "dim", "t", "bucket", "vec_id", "own", "unit", "codes"])

    usable = vectors.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, v -> v is null)")
    return usable.select("vec_id", "label", F.expr("transform(embedding, v -> cast(v as double))").alias("embedding")).mapInArrow(
        run, "label bigint, dim int, t int, bucket int, vec_id bigint, own boolean, unit binary, codes binary")


def _compare(cosine: float):
    def side(column: pa.Array, i: int) -> tuple[np.ndarray, ...]:
        rows = column[i].values
        n = len(rows)
        wide = lambda c, t: np.frombuffer(b"".join(rows.field(c).to_pylist()), t).reshape(n, -1)
        return rows.field("vec_id").to_numpy(), np.asarray(rows.field("own").to_numpy(zero_copy_only=False)), wide("unit", np.float64), wide("codes", np.int32).reshape(n, TABLES, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                t, bucket, same = (batch.column(c)[i].as_py() for c in ("t", "bucket", "same"))
                (ia, oa, xa, ca), (ib, ob, xb, cb) = side(batch.column("x"), i), side(batch.column("y"), i)
                near = (xa @ xb.T >= cosine) & (oa[:, None] | ob[None, :]) & (ia[:, None] != ib[None, :])
                p, q = np.nonzero(np.triu(near, 1) if same else near)
                if not len(p):
                    continue
                a, b = ca[p], cb[q]
                ab, ba = (a == b[:, :, :1]).any(2), (b == a[:, :, :1]).any(2)  # b's own among a's probes; and the reverse
                first = (ab | ba)[:, :t].any(1)
                none = np.iinfo(np.int32).max
                where = np.minimum(np.where(ab[:, t], b[:, t, 0], none), np.where(ba[:, t], a[:, t, 0], none))
                keep = ~first & (where == bucket)
                p, q = p[keep], q[keep]
                ids, inverse = np.unique(np.concatenate([ia[p], ib[q]]), return_inverse=True)
                if not len(ids):
                    continue
                u, v = inverse[: len(p)], inverse[len(p):]
                root = np.arange(len(ids))
                while True:  # the smallest index spreads over the links of the block
                    low = np.minimum(root[u], root[v])
                    new = root.copy()
                    np.minimum.at(new, u, low)
                    np.minimum.at(new, v, low)
                    if (new == root).all():
                        break
                    root = new
                out.append((ids, np.bincount(inverse, minlength=len(ids)), ids[root]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["vec_id", "n", "root"])

    return run


def near_copies(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    vectors = vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(label as bigint) label", "embedding")
    key = ["label", "dim", "t", "bucket"]
    entries = materialize(_entries(vectors.distinct()), "entries")
    met = entries.groupBy(*key).agg(F.count("*").alias("m"), F.max("own").alias("any_own")).where("m > 1 and any_own").select(*key, "m")
    blocks = entries.join(met, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / BLOCK))).groupBy(*key, "block").agg(
        F.collect_list(F.struct("vec_id", "own", "unit", "codes")).alias("x"))
    blocks = materialize(blocks, "blocks")
    pairs = blocks.join(blocks.select(*key, F.col("block").alias("other"), F.col("x").alias("y")), key).where("block <= other").select(
        "t", "bucket", (F.col("block") == F.col("other")).alias("same"), "x", "y")
    found = materialize(pairs.mapInArrow(_compare(cosine), "vec_id bigint, n bigint, root bigint"), "links")
    comps = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    smallest = comps.groupBy("comp").agg(F.min("node").alias("component_id"))
    by_node = comps.join(smallest, "comp").select(F.col("node").alias("vec_id"), "component_id")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return vectors.select("vec_id").distinct().join(counts, "vec_id", "left").join(by_node, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))

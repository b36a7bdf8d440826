"""Token ids of whole texts in a binary file format, and reading them back.

The file is a Parquet table of segments, so that Spark's committers guard it against lost executors and
any file system will do. A segment holds consecutive documents of about ``SEGMENT`` ids:

    part, seq      order of the segments; all ids in this order are one concatenated array
    n_docs, n_ids  sizes
    doc_ids        int64 little-endian, one per document; null_ids marks (bits) those that were null
    width, ids     2 or 4 bytes per id, little-endian
    low, high, samples   Elias-Fano code of the end offset of each document within the segment

Rows go in ascending (doc_id, text) order, null doc_id first; repeated rows are written each. A null text
counts as empty and holds the end id alone. An empty table gives a file without segments. Columns
other than doc_id and text are not read, whatever their names.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.llm import words as W
from packloom.llm.elias_fano import EliasFano
from packloom.llm.encoder import word_encoder

SEGMENT = 1 << 20
SCHEMA = (
    "part int, seq int, n_docs int, n_ids bigint, doc_ids binary, null_ids binary, width int, ids binary, "
    "low binary, high binary, samples binary"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
    ("null_ids", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("high", pa.binary()),
    ("samples", pa.binary()),
])


def _segment(part: int, seq: int, docs: list, ids: list, counts: list, width: int) -> pa.RecordBatch:
    doc_ids = pa.concat_arrays(docs)
    flat, n = np.concatenate(ids), np.concatenate(counts)
    ends = np.cumsum(n)
    low, high, samples = EliasFano.build(ends, int(ends[-1])).parts()
    null = np.packbits(np.asarray(doc_ids.is_null()), bitorder="little").tobytes()
    values = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    row = (part, seq, len(n), len(flat), values, null, width, flat.astype(f"<u{width}").tobytes(), low, high, samples)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types)], schema=_ARROW)


def encode_segments(docs: DataFrame, tokenizer_path: str, end_id: int, segment: int = SEGMENT) -> DataFrame:
    """Segments of all documents. One shuffle by range of doc_id, salted by the text so that one
    repeated doc_id does not land in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        width = 2 if max(enc.n_ids, end_id + 1) <= 1 << 16 else 4
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        keys, parts, counts = [], [], []
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            key = batch.column("doc_id")
            for lo, hi in W.slices(offsets):
                ids, n = enc.encode(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                ended = np.full(len(ids) + len(n), end_id, np.int64)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n, cuts = n + 1, np.cumsum(n + 1)
                a = 0
                while a < len(n):  # fill the open segment; a longer document has one of its own
                    done = cuts[a - 1] if a else 0
                    b = min(len(n), max(a + 1, int(np.searchsorted(cuts, done + segment - size, "right"))))
                    keys.append(key.slice(lo + a, b - a))
                    parts.append(ended[done: cuts[b - 1]].astype(f"<u{width}"))
                    counts.append(n[a:b])
                    size += int(cuts[b - 1] - done)
                    a = b
                    if size >= segment or a < len(n):
                        yield _segment(part, seq, keys, parts, counts, width)
                        seq, size, keys, parts, counts = seq + 1, 0, [], [], []
        if counts:
            yield _segment(part, seq, keys, parts, counts, width)

    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_salt"))
        .repartitionByRange("doc_id", "_salt")
        .sortWithinPartitions("doc_id", "_salt", "text")
        .select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
    )


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment: int = SEGMENT) -> None:
    encode_segments(docs, tokenizer_path, end_id, segment).write.option("compression", "zstd").parquet(path)


def open_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _bases(segments: DataFrame) -> DataFrame:
    """Ids before each segment: sums per part first, so that the one ordered pass sees a row per part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return segments.select("part", "seq", within.alias("base"), "n_ids").join(before, "part").select(
        "part", "seq", (F.col("base") + F.col("part_base")).alias("base"))


def document(row, i: int) -> np.ndarray:
    """Ids of the ``i``-th document of one segment, by two selects; no other boundary is decoded."""
    ends = EliasFano(row["n_docs"], row["n_ids"], row["low"], row["high"], row["samples"])
    a, b = (ends.select(i - 1) if i else 0), ends.select(i)
    return np.frombuffer(row["ids"], f"<u{row['width']}")[a:b]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 of every document in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["n_docs"], r["n_ids"], r["low"], r["high"], r["samples"]).all()
                ids, starts = np.frombuffer(r["ids"], f"<u{r['width']}"), np.concatenate(([0], ends[:-1]))
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), bitorder="little", count=r["n_docs"]).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.array(np.full(len(ends), r["part"], np.int32)),
                    pa.array(np.full(len(ends), r["seq"], np.int32)), pa.array(starts), pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                ], names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    segments = open_segments(spark, path)
    rows = segments.mapInArrow(run, "doc_id bigint, part int, seq int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(_bases(segments), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns (role, text); the empty one is the root. A node is known by its smallest
member conversation and its depth.

Digests. Every turn is hashed twice to 64 bits, with its depth; the xor of a run of turns is the run's digest, so
digests of blocks and of prefixes follow from each other by xor. 128 bits and the depth stand for a sequence.

Blocks first. Turns are folded into blocks of ``BLOCK`` turns, and conversations are grouped by the digests of their
successive blocks: one row for each distinct (prefix before the block, block), with the number of conversations
and the smallest of them. Copies are one row from here on. Only where a prefix is followed by different blocks are
the turn boundaries inside these blocks compared; a block without siblings is a chain of nodes with the same members.

Sums over subtrees. The nodes with one smallest member c form a path, from some depth to the end of c. The
paths form a tree, far less deep than the trie; sums over it are made by doubling the reach a round. Sums along a
path are made in slices of ``SLICE`` nodes and stitched, as are positions within a conversation, so one
conversation may hold most turns. Identifiers for ``ends_sha256`` are joined in slices of ``SLICE`` ids and
streamed through the hash in order, so a node that ends any number of conversations needs no memory.

Rows without conv_id are left out; a null role or text is empty; turns with a null number come first, turns with equal
numbers by role, then text, and repeated rows are turns of their own. An empty table gives no node.
Columns other than conv_id, turn, role and text are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.session import materialize

BLOCK = 8
SLICE_BITS = 12  # slices of 4096 turns, nodes or conversation ids
_LOWEST = -(1 << 62)
_BEFORE = (Window.unboundedPreceding, -1)
_ENDS = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
_ENDS_ARROW = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words) of every turn: position from 0, two hashes, and words of its text."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    ).withColumn("slice", F.coalesce(F.shiftright("turn", SLICE_BITS), F.lit(_LOWEST)))
    offsets = turns.groupBy("conv_id", "slice").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(*_BEFORE)), F.lit(0)))
    order = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("at", F.row_number().over(order) - 1).select(
        "conv_id", "slice", "at", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    return placed.join(offsets, ["conv_id", "slice"]).select(
        "conv_id", (F.col("at") + F.col("before")).alias("pos"), "t1", "t2", "words")


def rebuilt(conversations: DataFrame, step: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns taken from conversation c - c % step, where
    h = crc32(c in decimal) % heads. Returns its turns, as ``numbered`` gives them, and (conv_id, n_turns) of all."""
    own = materialize(numbered(conversations), "turns")
    root = F.col("conv_id") % step == 0
    counts = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    lent = counts.where(root).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = counts.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % step).alias("base"),
        F.when(root, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"),
    ).join(lent, "base", "left").select(
        "conv_id", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    plan = materialize(plan, "rebuilt")
    tails = own.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "words")
    first = own.where(root & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    borrowed = plan.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos < taken").select(
        "conv_id", "pos", "t1", "t2", "words")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return tails.unionByName(borrowed), lengths


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: (conv_id, block, p1, p2, x1, x2, m, turns), p being the digest of all
    turns before the block, x that of its own m turns, and turns their (depth, l1, l2, words) in order."""
    turns = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "words").select(
        "conv_id", "depth", F.xxhash64("t1", "depth").alias("l1"), F.xxhash64("t2", "depth").alias("l2"), "words")
    blocks = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {block}").alias("block")).agg(
        F.bit_xor("l1").alias("x1"), F.bit_xor("l2").alias("x2"), F.count("*").alias("m"),
        F.sort_array(F.collect_list(F.struct("depth", "l1", "l2", "words"))).alias("turns"),
    ).withColumn("slice", F.shiftright("block", SLICE_BITS))
    along = Window.partitionBy("conv_id", "slice").orderBy("block").rowsBetween(*_BEFORE)
    slices = blocks.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    over = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(*_BEFORE)
    slices = slices.select("conv_id", "slice", *(F.coalesce(F.bit_xor(s).over(over), F.lit(0)).alias(s) for s in ("s1", "s2")))
    found = blocks.withColumns({p: F.coalesce(F.bit_xor(x).over(along), F.lit(0)) for p, x in (("p1", "x1"), ("p2", "x2"))})
    return found.join(slices, ["conv_id", "slice"]).select(
        "conv_id", "block", _xor("p1", "s1").alias("p1"), _xor("p2", "s2").alias("p2"), "x1", "x2", "m", "turns")


def _boundaries(blocks: DataFrame) -> DataFrame:
    """Every turn boundary inside distinct blocks: (depth, k1, k2, q1, q2, words, n_convs, conv_id); k is the
    digest of the sequence up to it, q that of its parent."""
    upto = lambda p, lane, less: f"aggregate(slice(turns, 1, i - {less}), {p}, (acc, t) -> acc ^ t.{lane})"
    inner = F.expr(f"""transform(sequence(1, cast(m as int)), i -> struct(
        turns[i - 1].depth as depth, {upto('p1', 'l1', 0)} as k1, {upto('p2', 'l2', 0)} as k2,
        {upto('p1', 'l1', 1)} as q1, {upto('p2', 'l2', 1)} as q2, turns[i - 1].words as words))""")
    return blocks.select(F.explode(inner).alias("at"), "n_convs", "conv_id").select("at.*", "n_convs", "conv_id")


def _nodes(blocks: DataFrame) -> DataFrame:
    """Nodes but the root, as ``_boundaries`` gives them."""
    distinct = materialize(blocks.groupBy("block", "p1", "p2", "x1", "x2", "m").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("smallest"), F.min_by("turns", "conv_id").alias("turns"),
    ).withColumnRenamed("smallest", "conv_id"), "blocks")
    siblings = distinct.groupBy("block", "p1", "p2").agg(F.count("*").alias("siblings"))
    distinct = distinct.join(siblings, ["block", "p1", "p2"])
    chains = _boundaries(distinct.where("siblings = 1"))
    refined = _boundaries(distinct.where("siblings > 1")).groupBy("depth", "k1", "k2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"))
    return chains.unionByName(refined)


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each key, which come one after the other."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *now, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "part"))):
            if now != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _ENDS_ARROW.types)], schema=_ENDS_ARROW)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, digest.hexdigest()), _ENDS_ARROW.types)], schema=_ENDS_ARROW)


def _ends(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node that ends a conversation."""
    ends = blocks.groupBy("conv_id").agg(F.sum("m").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    nothing = F.lit(0).cast("bigint")
    ends = ends.unionByName(lengths.where("n_turns = 0").select(
        "conv_id", nothing.alias("depth"), nothing.alias("k1"), nothing.alias("k2")))
    parts = ends.groupBy("depth", "k1", "k2", F.shiftright("conv_id", SLICE_BITS).alias("slice")).agg(
        F.expr("concat_ws(',', transform(sort_array(collect_list(conv_id)), c -> cast(c as string)))").alias("part"))
    return parts.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "slice").mapInArrow(_stream_hash, _ENDS)


def _path_totals(paths: DataFrame, top: int) -> DataFrame:
    """(conv_id, n_leaves, saved) of each path with all paths below it, from (conv_id, up, n_leaves, saved).
    After round r every path holds the sums of those less than 2**r steps below, and ``up`` leads 2**r steps up."""
    state = materialize(paths, "paths")
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        onward = state.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = state.where(F.col("up") != top).join(onward, "up", "left").unionByName(
            state.where(F.col("up").isNull() | (F.col("up") == top)).withColumn("next", F.lit(None).cast("bigint")))
        state = materialize(moved.join(below, "conv_id", "left").select(
            "conv_id", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "paths")
    return state.select("conv_id", "n_leaves", "saved")


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, pos, t1, t2, words); ``lengths`` (conv_id, n_turns) has every
    conversation, those without turns too.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = materialize(_blocks(turns, block), "conversation-blocks")
    top, n_all = lengths.agg(F.min("conv_id"), F.count("*")).first()
    if top is None:  # no conversation: nothing equals a null id
        top = _LOWEST
    spark = turns.sparkSession
    found = materialize(_nodes(blocks), "nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    linked = found.where("depth > 1").join(above, ["depth", "q1", "q2"]).drop("q1", "q2").unionByName(
        found.where("depth = 1").drop("q1", "q2").withColumn("parent_conv_id", F.lit(top).cast("bigint")))
    root = spark.range(1 if n_all else 0).select(*(F.lit(v).cast("bigint").alias(c) for c, v in {
        "depth": 0, "k1": 0, "k2": 0, "words": 0, "n_convs": n_all, "conv_id": top, "parent_conv_id": None}.items()))
    ends = _ends(blocks, lengths)
    nodes = materialize(linked.unionByName(root).join(ends, ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.col("n_children").isNull().cast("bigint"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    }), "nodes")

    begins = F.col("parent_conv_id") != F.col("conv_id")  # first node of a path
    paths = nodes.groupBy("conv_id").agg(
        F.max(F.when(begins, F.col("parent_conv_id"))).alias("up"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    below = nodes.where(begins).select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("depth")).join(
        _path_totals(paths, top), "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    nodes = materialize(nodes.join(below, ["conv_id", "depth"], "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
        "slice": F.shiftright("depth", SLICE_BITS),
    }).drop("more_leaves", "more_saved"), "nodes")
    deeper = Window.partitionBy("conv_id").orderBy(F.col("slice").desc()).rowsBetween(*_BEFORE)
    slices = nodes.groupBy("conv_id", "slice").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")).select(
        "conv_id", "slice", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("l", "s")))
    onward = Window.partitionBy("conv_id", "slice").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumns({c: F.sum(c).over(onward) for c in ("n_leaves", "saved")}).join(slices, ["conv_id", "slice"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("l")).alias("n_leaves"),
        (F.col("saved") + F.col("s")).alias("saved_tokens"), "ends_sha256")

"""Benchmark passages in whole documents, by DataFrame functions only.

Windows have the size of the item (its L words); a text shorter than L is one window. The similarity of a
window and an item is the weighted Jaccard of their shingles of five words (words [^\\x20\\x09-\\x0D]+, A-Z lowered; a shingle weighs
as often as it occurs; with fewer than five words the whole sequence is one shingle).

1. Anchors. A window of similarity >= 0.8 lacks at most a fifth of the item's n shingles, so it holds one of
   any floor(n / 5) + 1 of them. Those with the longest words are looked up, by their longest word first. Texts and windows
   without any are left out; nothing else is.
2. Fingerprints. Every window that holds an anchor found gets a 64-bit SimHash of its weighted shingles.
3. Multi-index. Fingerprints are cut into eight blocks of eight bits; items are listed under each block's value
   and its 36 neighbours at one and two bits. Two fingerprints within ``RADIUS`` = 23 bits agree on a block up to two
   bits, so the join on (L, block, value) finds all of them.
4. Candidates within the radius are verified by the exact similarity.

A window beyond the radius is not reported; at similarity 0.8 or more that hardly occurs. Null texts and items count as empty and match nothing; rows with a null doc_id are reported with it. Equal texts are
worked on once. Repeated items are reported under each item_id. Columns other than doc_id, text, item_id are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.session import materialize

RADIUS, WIDTH = 23, 5
SIMILARITY = 0.8
BROADCAST_ROWS = 100_000
_BLOCKS = 8


def words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x20\x09-\x0D]+"), 0)


def shingle_codes(ws: Column) -> Column:
    """64-bit codes of the shingles of an array of words, in order."""
    n = F.size(ws)
    starts = F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, WIDTH), " "))))


def _items(benchmark: DataFrame) -> DataFrame:
    ws = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    return ws.select("item_id", "ws", F.size("ws").alias("length"), shingle_codes(F.col("ws")).alias("codes"))


def _anchors(items: DataFrame) -> DataFrame:
    """word (the longest of the shingle), its place in the shingle, the shingle's code and size, L of the item."""
    n = F.size("codes")
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        (-F.length(F.array_join(F.slice("ws", i, WIDTH), " "))).alias("rank"), i.alias("i")))
    chosen = F.slice(F.array_sort(places), 1, F.floor(n / 5).cast("int") + 1)
    each = items.select("ws", "length", "codes", F.explode(chosen).alias("c")).select(
        "length", F.slice("ws", F.col("c.i"), WIDTH).alias("sh"), F.element_at("codes", F.col("c.i")).alias("code"))
    longest = F.array_max(F.transform("sh", lambda w, k: F.struct(F.length(w).alias("n"), k.alias("k"), w.alias("w"))))
    return each.withColumn("m", longest).select(
        F.col("m.w").alias("word"), F.col("m.k").alias("place"), F.size("sh").alias("width"), "code", "length").distinct()


def _spread(byte: Column) -> Column:
    """The eight bits of a byte, each as a byte of a 64-bit counter."""
    out = byte.bitwiseAND(F.lit(1))
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(byte, i).bitwiseAND(F.lit(1)), 8 * i))
    return out


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks b0..b7 of the SimHash of each group's ``code`` rows. A window has fewer than 32768 shingles
    per counter step: sums are kept per bit in two halves of wider counters where items are long."""
    byte = [F.shiftrightunsigned(F.col("code"), 8 * j).bitwiseAND(F.lit(255).cast("bigint")) for j in range(_BLOCKS)]
    # Counters of a byte hold 127 rows; longer windows are summed in parts of 100 first.
    parts = rows.withColumn("part", F.floor(F.col("at") / 100)).groupBy(*keys, "part").agg(
        F.count("*").alias("n"), *[F.sum(_spread(b)).alias(f"s{j}") for j, b in enumerate(byte)])
    counts = lambda j: F.array(*[F.shiftrightunsigned(F.col(f"s{j}"), 8 * i).bitwiseAND(F.lit(255).cast("bigint")) for i in range(8)])
    bits = parts.select(*keys, "n", *[counts(j)[i].alias(f"c{j}_{i}") for j in range(_BLOCKS) for i in range(8)])
    sums = bits.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"c{j}_{i}").alias(f"c{j}_{i}") for j in range(_BLOCKS) for i in range(8)])

    def block(j: int) -> Column:
        out = F.lit(0)
        for i in range(8):
            out = out + F.when(F.col(f"c{j}_{i}") * 2 > F.col("n"), 1 << i).otherwise(0)
        return out

    return sums.select(*keys, *[block(j).alias(f"b{j}") for j in range(_BLOCKS)])


def _code_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("codes").alias("at", "code"))


def _fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    small = _blocks(_code_rows(df, keys), keys)
    return small.select(*keys, F.array(*[F.col(f"b{j}") for j in range(_BLOCKS)]).alias("fp"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the counts of two arrays."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))
    return shared / (F.size(a) + F.size(b) - shared)


def _hits(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places of anchor words in all texts; the anchors are broadcast only up to a checked number."""
    small = anchors.count() <= BROADCAST_ROWS
    side = F.broadcast(anchors) if small else anchors
    spots = texts.select("h", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return spots.join(side, "word").select("h", (F.col("pos") - F.col("place")).alias("start"), "width", "code", "length").distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """h (hash of the text), item_id, similarity, hamming, start of the best window of each text and item."""
    texts = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    items = materialize(_items(benchmark), "items")
    anchors = materialize(_anchors(items), "anchors")
    hits = materialize(_hits(texts, anchors), "anchor-words")
    held = texts.join(hits.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    held = materialize(held.select("h", words(F.col("text")).alias("ws")), "anchored")
    # The whole shingle must stand there; then every window of L words that holds it is taken.
    there = hits.where("start >= 0").join(held, "h").where(
        F.xxhash64(F.array_join(F.slice("ws", F.col("start") + 1, F.col("width")), " ")) == F.col("code"))
    last = F.greatest(F.size("ws") - F.col("length"), F.lit(0))
    reach = F.greatest(F.col("length") - F.col("width"), F.lit(0))
    starts = there.select("h", "length", F.greatest(F.col("start") - reach, F.lit(0)).alias("lo"), F.least(F.col("start"), last).alias("hi")).distinct()
    windows = starts.where("lo <= hi").select("h", "length", F.explode(F.sequence("lo", "hi")).alias("start")).distinct()
    cut = windows.join(held, "h").select("h", "length", "start", shingle_codes(F.slice("ws", F.col("start") + 1, F.col("length"))).alias("codes"))
    cut = materialize(cut, "windows")
    keys = ["h", "length", "start"]
    prints = materialize(_fingerprints(cut, keys), "prints")
    marked = items.join(_fingerprints(items.select("item_id", "codes").dropDuplicates(["item_id", "codes"]), ["item_id", "codes"]), ["item_id", "codes"])
    flips = [x for x in range(256) if x.bit_count() <= RADIUS // _BLOCKS]
    index = marked.select("item_id", "length", "codes", F.col("fp").alias("item_fp"), F.posexplode("fp").alias("block", "value")).select(
        "item_id", "length", "codes", "item_fp", "block", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"))
    probes = prints.select(*keys, "fp", F.posexplode("fp").alias("block", "value"))
    apart = F.aggregate(F.zip_with("fp", "item_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = probes.join(index, ["length", "block", "value"]).withColumn("hamming", apart).where(F.col("hamming") <= RADIUS).select(
        *keys, "item_id", F.col("codes").alias("item_codes"), "hamming").distinct()
    scored = pairs.join(cut, keys).withColumn("similarity", weighted_similarity(F.col("codes"), F.col("item_codes"))).where(
        F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("near"), (-F.col("start")).alias("early"))).alias("best")
    return scored.groupBy("h", "item_id").agg(best).select(
        "h", "item_id", "best.similarity", (-F.col("best.near")).alias("hamming"), (-F.col("best.early")).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start: one row per document and item found in it."""
    found = materialize(find(docs, benchmark), "leaks")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"))
    return rows.join(found, "h").select("doc_id", "item_id", "similarity", "hamming", "start")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in whose text no item was found."""
    found = materialize(find(docs, benchmark).select(F.col("h").alias("_leak")).distinct(), "leaks")
    return docs.join(found, F.xxhash64(docs["text"]) == found["_leak"], "left_anti")

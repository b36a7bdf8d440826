"""Connected components of a table of links, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is one of the component's nodes.

    In each round every node looks up the neighbour (or itself) of the smallest hash and moves where that one
    goes; the links follow. A path or star of any length shrinks by a constant factor a round. Only partial aggregates and joins
    on nodes; each round is written to the shared folder. Null ends are left out; repeated links and
    loops do no harm.
    """
    edges = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = materialize(nodes.select("node", F.col("node").alias("comp")), "components")
    edges = materialize(edges.where("a <> b").distinct(), "links")
    step = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("comp"), F.least("m", rank("a"))["v"].alias("to"))
        onward = best.select(F.col("comp").alias("to"), F.col("to").alias("x"))
        best = materialize(best.join(onward, "to").select("comp", F.col("x").alias("to")), "moves")
        found = materialize(found.join(best, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")
        to = best.select(F.col("comp").alias("a"), F.col("to").alias("x"))
        moved = edges.join(to, "a").select("x", "b").join(best.select(F.col("comp").alias("b"), "to"), "b").select(
            F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "links")
        step += 1
    return found


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, comp), as ``components`` gives it, after more links (a, b): only the links between
    different components are worked on. ``known`` is read several times: pass a written table."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    moved = components(ends)
    step = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = known.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return materialize(old.unionByName(moved.join(known.select("node"), "node", "left_anti")), "components")

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.session import discard, write_scratch


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each u and all its v."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (columns a, b of one ordered type).

    A large-star step hangs the larger neighbours of each node on the least of them, a small-star step the smaller ones;
    repeated until nothing changes, all nodes hang on their component's least.  Loops and repeated edges do no harm; no
    edges give no rows.  The tables of a step are deleted after it, the last one by ``discard`` of the result.
    """
    loops = edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    forward = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    forward = write_scratch(forward, "edges")
    before = None
    while True:
        both = forward.unionByName(forward.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node may have very many neighbours: with written minima Spark can split its rows like those of any skewed join
        least = write_scratch(_least(both), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = write_scratch(large, "large")
        discard(forward, least)
        hung = large.join(_least(large), "u")  # after a large-star step a node has few smaller neighbours
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        forward = write_scratch(small, "small")
        discard(large)
        now = forward.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = forward.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = forward.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = found.unionByName(roots).unionByName(loops.join(found, "node", "left_anti")).distinct()
    out.scratch_path = forward.scratch_path
    return out

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are hung onto the smallest of them and the node.

    large: the larger neighbours only; small: the smaller ones, with the node itself.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge: component is the smallest id that edges reach.

    edges has columns a and b (long, not null; either order, repeats and loops allowed). The stars converge
    in about the logarithm of the longest path; each step is a minimum by key with partial sums and a
    join whose hot keys AQE splits. Steps are written to the shared folder. An id that only has loops
    isn't returned. unstash() deletes what the result reads.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    told = None
    while True:
        then = stash(_star(_star(now, large=True), large=False), "edges")
        print_of = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstash(now)
        now = then
        if tuple(print_of) == told or not print_of[0]:
            break
        told = tuple(print_of)
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct().toDF("id", "component"))
    out._stash_path = now._stash_path
    return out

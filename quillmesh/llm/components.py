"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, materialise


def _mins(edges: DataFrame) -> DataFrame:
    """u with the least of its neighbours and itself; combined before the shuffle, so hubs are cheap.

    Written, so that a join with it has a plain table on both sides: a small
    one is broadcast, and a hub's rows can be split (adaptive skew joins).
    """
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "mins")


def large_star(edges: DataFrame, written: list[DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    written.append(mins := _mins(both))
    linked = both.filter("v > u").join(mins, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame, written: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    written.append(mins := _mins(down))
    moved = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(mins.withColumnRenamed("m", "v")).filter("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the least of its component, with that least node.

    ``edges`` holds (u, v) of one orderable type, in any direction; loops and
    repeats are harmless. Nodes without edges do not appear.
    """
    edges = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(edges)
    while True:
        written = [edges]
        written.append(large := materialise(large_star(edges, written), "large"))
        edges = materialise(small_star(large, written), "edges")
        discard(*written)
        now = print_of(edges)
        if now == seen:
            return edges
        seen = now

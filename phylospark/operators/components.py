"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.shared import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))).alias("s"),
    ).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round; every edge has u > v.

    Large-star looks at all neighbours of a node and moves the larger ones to
    the least; small-star moves the smaller neighbours (and the node) there.
    The least neighbour is a partially aggregated min, so a hub costs one row
    per task before the exchange, and the join back can be split by AQE.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Nodes of an undirected graph with the least node they can reach.

    ``edges`` holds pairs of any orderable type; loops, repeats and null ends
    are ignored. Returns ``node, component`` for every node with an edge to
    another one; an empty input gives no rows. Each round is written to the
    shared folder, and the loop ends when a round leaves the edges as they were.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = cut(_star(_star(now, True), False))
        last, seen = seen, _signature(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components by repeated contraction (op N4)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(pair).alias("_p")).select("_p.a", "_p.b")


def _jump(pointer: DataFrame) -> DataFrame:
    """Point every node at its pointer's pointer."""
    onward = pointer.select(F.col("node").alias("p"), F.col("p").alias("_q"))
    return pointer.join(onward, "p").select("node", F.col("_q").alias("p"))


def _priority(round_no: int, node):
    return F.struct(F.xxhash64(F.lit(round_no), node).alias("h"), node.alias("n"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` with the smallest node id of the component as label.

    ``edges``: src, dst (undirected, repeats and loops allowed); ``nodes``: node, adds isolated ones.

    Every round gives the nodes a fresh pseudo-random priority and points each node at the one of
    least priority within two steps. Such pointer chains are short, so a few jumps lead to their
    roots whatever the order of the ids; the edges are then rewritten between roots. The edge table shrinks geometrically, all rounds together cost about as much as the
    first, and the pointer tables are composed from the smallest upwards. A hub's neighbour minimum
    is combined map-side, and its edges are only rewritten by equi-joins.
    """
    both = edges.where(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()
    current = materialise(both, "edges")
    maps: list[DataFrame] = []
    for round_no in count():
        if current.isEmpty():
            break
        both_ways = _both_ways(current)
        near = both_ways.groupBy("a").agg(F.min(_priority(round_no, F.col("b"))).alias("m")).select(
            "a", F.least(_priority(round_no, F.col("a")), F.col("m")).alias("m")
        )
        # least priority within two steps
        far = both_ways.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        pointer = far.select(F.col("a").alias("node"), F.col("m.n").alias("p"))
        shortened = materialise(_jump(_jump(pointer)), "pointer")
        left = shortened.select(F.col("node").alias("src"), F.col("p").alias("ps"))
        right = shortened.select(F.col("node").alias("dst"), F.col("p").alias("pd"))
        rewritten = (
            current.join(left, "src").join(right, "dst")
            .where(F.col("ps") != F.col("pd"))
            .select(F.least("ps", "pd").alias("src"), F.greatest("ps", "pd").alias("dst"))
            .distinct()
        )
        maps.append(shortened)
        following = materialise(rewritten, "edges")
        discard(current)
        current = following
    if not maps:
        labels = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    else:
        labels = maps[-1]
        for smaller in reversed(maps[:-1]):
            upper = labels.select(F.col("node").alias("p"), F.col("p").alias("_q"))
            labels = smaller.join(upper, "p", "left").select("node", F.coalesce("_q", "p").alias("p"))
        rooted = materialise(labels, "roots")
        least = rooted.groupBy("p").agg(F.min("node").alias("component"))
        labels = rooted.join(least, "p").select("node", "component")
    if nodes is not None:
        alone = nodes.select("node").distinct().join(labels.select("node"), "node", "left_anti")
        labels = labels.unionByName(alone.select("node", F.col("node").alias("component")))
    return materialise(labels, "components")

"""Graph operators for graphs of any size and any length of path: least labels, reachability, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach, itself included).

    nodes has the column node; edges has src and dst, directions and repeats ignored,
    as are null ends and ends that are no node. Null nodes go, repeated ones count
    once. Each round takes the least label of a node and its neighbours, then the
    label of that label, so chains shorten by more than a step a round.
    """
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    both = kept(_between(both, known).distinct(), "graph")
    labels = kept(known.withColumn("component", F.col("node")), "graph")
    while True:
        heard = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "component")
        least = labels.unionByName(heard).groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        told = least.join(jump, "near").select("node", F.least("near", "far").alias("component"))
        new = kept(told.join(labels.withColumnRenamed("component", "before"), "node"), "graph")
        labels = new.select("node", "component")
        if not new.where("component <> before").limit(1).count():
            return labels


def _between(arcs: DataFrame, known: DataFrame) -> DataFrame:
    return arcs.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi")


def reachability(nodes: DataFrame, arcs: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, node, hops: every node that directed arcs (src, dst) lead to from each origin (origin), the origin at 0 hops.

    One step a round from what the round before added, until nothing is added: no
    depth is too deep, cycles end. The result has a row for each pair that is
    reachable; take as many origins as that allows.
    """
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    steps = kept(_between(arcs.select("src", "dst").where("src <> dst"), known).distinct(), "graph")
    start = origins.select("origin").distinct().join(known, F.col("origin") == F.col("node")).select("origin", "node").withColumn("hops", F.lit(0))
    found = front = kept(start, "graph")
    hops = 0
    while True:
        hops += 1
        next_ = front.join(steps, front["node"] == steps["src"]).select("origin", F.col("dst").alias("node")).distinct()
        front = kept(next_.join(found, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hops)), "graph")
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)
        if hops % 10 == 0:
            found = kept(found, "graph")


def shortest_paths(nodes: DataFrame, arcs: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, node, km, path (array of nodes): the shortest way over arcs (src, dst, km >= 0) from each origin (origin) to every node; null where there is none.

    Rounds of relaxation from the nodes whose way became shorter in the round before;
    of ways of one length that with the lesser path stays.
    """
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    steps = kept(_between(arcs.select("src", "dst", "km").where("src <> dst"), known).groupBy("src", "dst").agg(F.min("km").alias("step")), "graph")
    start = origins.select("origin").distinct().join(known, F.col("origin") == F.col("node"))
    best = kept(start.select("origin", "node", F.lit(0.0).alias("km"), F.array("node").alias("path")), "graph")
    front = best
    while True:
        tried = front.join(steps, front["node"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        tried = tried.select("origin", F.col("dst").alias("node"), (F.col("km") + F.col("step")).alias("km"), F.concat("path", F.array("dst")).alias("path"))
        way = F.min(F.struct("km", "path")).alias("way")
        tried = tried.groupBy("origin", "node").agg(way).select("origin", "node", F.col("way.km").alias("new_km"), F.col("way.path").alias("new_path"))
        shorter = F.col("km").isNull() | (F.col("new_km") < F.col("km"))
        front = kept(tried.join(best, ["origin", "node"], "left").where(shorter).select("origin", "node", F.col("new_km").alias("km"), F.col("new_path").alias("path")), "graph")
        if not front.limit(1).count():
            break
        rank = F.row_number().over(Window.partitionBy("origin", "node").orderBy("km", "path"))
        best = kept(best.unionByName(front).withColumn("_r", rank).where("_r = 1").drop("_r"), "graph")
    pairs = start.select("origin").crossJoin(known)  # the answer: a row for every origin and node
    return pairs.join(best, ["origin", "node"], "left")

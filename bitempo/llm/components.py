"""Connected components of a graph of long ids, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest reachable id) of every id in edges (a, b).

    Each round hooks every id that has a smaller neighbour to the smallest, follows
    hooks up to four steps, and contracts the edges to what the ids hang on, so only
    ids smaller than all their neighbours and few others are left. Counts by id are
    combined before they are shuffled, so a hub is no task's burden.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    rounds = 0
    while both.limit(1).count():
        hooks = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).where("low < x")
        for _ in range(2):
            up = hooks.select(F.col("x").alias("low"), F.col("low").alias("lower"))
            hooks = hooks.join(up, "low", "left").select("x", F.coalesce("lower", "low").alias("low"))
        hooks = written(hooks, "hooks")
        from_, to = hooks.select(F.col("x").alias("a"), F.col("low").alias("p")), hooks.select(F.col("x").alias("b"), F.col("low").alias("q"))
        both = written(both.join(from_, "a", "left").join(to, "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")).where("a <> b").distinct(), "edges")
        labels = labels.join(hooks, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("low", "comp").alias("comp"))
        rounds += 1
        if rounds % 5 == 0:
            labels = written(labels, "labels")
    return written(labels, "labels")

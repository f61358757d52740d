"""Connected components by smallest label, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowlattice.llm._common import attach_groups, cut, small_side

#: Up to so many labels are broadcast; beyond, hot ids and hot components are dealt out by attach_groups.
BROADCAST_LABELS = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: each id of the edges and the smallest id that it reaches.

    Each round takes the smallest label of an id and its neighbours, then the
    label of that label, so that paths halve; stars need two rounds. Labels
    never leave the executors. Loops, repeated edges and nulls change nothing;
    no edges give an empty table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    start = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component"), F.count("*").alias("degree")))
    n = start.count()
    small = n <= BROADCAST_LABELS
    n_edges = 0 if small else both.count()
    labels = start
    while True:
        if small:
            near = both.join(F.broadcast(labels), F.col("v") == F.col("id"))
        else:
            near = attach_groups(both, labels.withColumnRenamed("id", "v"), ["v"], "degree", n_edges, "u")
        near = near.groupBy(F.col("u").alias("n")).agg(F.min("component").alias("least"))
        met = near.join(small_side(labels, n), F.col("id") == F.col("n")).select("id", "degree", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        far = labels.select(F.col("id").alias("of"), F.col("component").alias("its"))
        if small:
            new = met.join(F.broadcast(far), F.col("component") == F.col("of"), "left")
        else:
            met = cut(met)
            roots = met.groupBy("component").agg(F.count("*").alias("size")).join(far, F.col("component") == F.col("of")).select("component", "its", "size")
            new = attach_groups(met, cut(roots), ["component"], "size", n, "id")
        moves = Observation()
        new = new.select("id", "degree", "old", F.least("component", "its").alias("component"))
        new = cut(new.observe(moves, F.sum((F.col("old") != F.col("component")).cast("long")).alias("n")))
        labels = new.select("id", "component", "degree")
        if not moves.get["n"]:
            return labels.select("id", "component")


def labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of the id in `column` as `name`: the id itself if labels lack it. labels is broadcast up to BROADCAST_LABELS rows."""
    side = small_side(labels.select(F.col("id").alias("__id"), F.col("component").alias("__component")), labels.count(), BROADCAST_LABELS)
    return rows.join(side, F.col(column) == F.col("__id"), "left").withColumn(name, F.coalesce("__component", column)).drop("__id", "__component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b), whose ids need no label.

    Links are first mapped to components, where most of them repeat each other,
    so only a graph of different components is searched.
    """
    ends = links.select("a", "b")
    new = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    every = cut(labels.unionByName(new.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))))
    pairs = labelled(labelled(ends, every, "a", "ca"), every, "b", "cb").filter("ca <> cb")
    up = components(cut(pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()))
    return cut(labelled(every, up, "component", "c").select("id", F.col("c").alias("component")))

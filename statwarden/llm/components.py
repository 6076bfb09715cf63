"""Connected components of a graph held as tables: nothing but a count of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwarden.llm.shared import written


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) for the nodes of ``edges`` (columns a, b; long).

    In each round a node takes the least label around it, the node that was its
    label takes the least of its followers', and labels are followed one step. A
    component of diameter d is done in about log(d) rounds. ``labels`` of an earlier
    graph, of which ``edges`` are further edges, shorten the work.
    """
    if labels is not None:
        # earlier components are single nodes by now
        known = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        for end in ("a", "b"):
            edges = edges.join(known, edges[end] == known["n"], "left").withColumn(end, F.coalesce("l", end)).drop("n", "l")
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    now = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        taken = now.join(near, now["node"] == near["a"]).select("node", "label", F.least("label", "least").alias("new"))
        hooked = taken.groupBy("label").agg(F.min("new").alias("hook"))
        taken = taken.join(hooked, "label").select("node", "label", F.least("new", "hook").alias("new"))
        over = taken.select(F.col("node").alias("new"), F.col("new").alias("further"))
        step = taken.join(over, "new").select("node", F.col("label").alias("old"), F.least("new", "further").alias("label"))
        step = written(step, "component-labels")
        now = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            break
    if labels is None:
        return now
    later = now.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(later, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = now.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return written(old.unionByName(fresh), "component-labels")

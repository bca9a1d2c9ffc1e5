"""Graphs of many plans at once: components, reachability and fewest steps, without paths or driver-side search.

Nodes and edges carry a graph key (the plan), so all graphs advance together;
each round is two equi joins on (graph, node), and lineage is cut by a written
table in the shared folder.  Rounds end when nothing changes, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.shared import by_shuffle, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """(g, a, b) in both directions, without loops, once each."""
    e = edges.select("g", "a", "b").where("a <> b and a is not null and b is not null")
    return e.unionByName(e.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, node, label): label is the least node of the component.

    Min-label propagation with pointer jumping, so long chains take about log2 of their length in rounds.
    Nodes without edges are their own component; edges to unknown nodes are ignored.
    """
    e = stored(both_ways(edges), "edges")
    state = stored(nodes.select("g", "node").distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = e.join(state.select("g", F.col("node").alias("b"), "label"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = state.join(near, ["g", "node"], "left").select("g", "node", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        jump = step.select("g", F.col("node").alias("next"), F.col("next").alias("further"))
        new = stored(step.join(jump, ["g", "next"], "left").select("g", "node", "label", F.least("next", F.coalesce("further", "next")).alias("new")), "labels")
        state = new.select("g", "node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return state


def reachable(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(g, node, reaches): whether a node's component holds a goal (g, node)."""
    c = components(nodes, edges)
    ends = c.join(goals.select("g", "node").distinct(), ["g", "node"], "left_semi").select("g", "label").distinct().withColumn("hit", F.lit(True))
    return c.join(ends, ["g", "label"], "left").select("g", "node", F.coalesce("hit", F.lit(False)).alias("reaches"))


def steps_to(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(g, node, steps, via): fewest edges to a goal and the next node on the way (least id of equal ones); nodes that reach none are left out.

    A breadth-first front: each round joins only the nodes met last.
    """
    e = stored(both_ways(edges), "edges")
    met = stored(nodes.join(by_shuffle(goals.select("g", "node").distinct()), ["g", "node"], "left_semi").select("g", "node", F.lit(0).alias("steps"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("via")), "met")
    front, k = met, 0
    while True:
        k += 1
        new = front.select("g", F.col("node").alias("b")).join(by_shuffle(e), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("b").alias("via"))
        new = new.join(by_shuffle(nodes.select("g", "node")), ["g", "node"], "left_semi").join(by_shuffle(met.select("g", "node")), ["g", "node"], "left_anti")
        front = stored(new.select("g", "node", F.lit(k).alias("steps"), "via"), "front")
        if front.isEmpty():
            return met
        met = met.unionByName(front)
        if k % 8 == 0:
            met = stored(met, "met")


def paths_to(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(g, node, steps, path): the nodes on a way of fewest edges to a goal, both ends included; of equally short ways the one whose next node is least.

    A path grows with the front that meets its first node, so each round joins the front's paths to the nodes met by it.
    """
    steps = stored(steps_to(nodes, edges, goals), "steps")
    most = steps.agg(F.max("steps")).first()[0]
    front = steps.where("steps = 0").select("g", "node", "steps", F.array("node").alias("path"))
    done = front
    for k in range(1, (most or 0) + 1):
        before = front.select("g", F.col("node").alias("via"), F.col("path").alias("rest"))
        front = stored(steps.where(F.col("steps") == k).join(by_shuffle(before), ["g", "via"]).select("g", "node", "steps", F.concat(F.array("node"), "rest").alias("path")), "paths")
        done = done.unionByName(front)
    return done

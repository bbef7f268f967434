"""Paths, communities and comparisons on graphs, beside the centralities of ``graph``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.operators import graph as G
from stackroom.session import cut


def simple_paths(edges: DataFrame, sources: DataFrame, most_nodes: int = 5) -> DataFrame:
    """(source, target, nodes): every path without a repeated node, of 2 to ``most_nodes`` nodes.

    sources: id. Grows by one join a step; what is returned is as long as the answer. Null ids have no path.
    """
    e = G.simple(edges)
    step = sources.select("id").where("id IS NOT NULL").distinct().select(F.col("id").alias("source"), F.col("id").alias("target"), F.array("id").alias("nodes"))
    out = None
    for _ in range(most_nodes - 1):
        step = cut(
            step.join(e, F.col("target") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
            .select("source", F.col("dst").alias("target"), F.concat("nodes", F.array("dst")).alias("nodes"))
        )
        out = step if out is None else out.unionByName(step)
    return out


def path_diversity(paths: DataFrame) -> DataFrame:
    """Per (source, target): number of paths, least, greatest and mean number of nodes, distinct inner nodes."""
    inner = F.explode_outer(F.slice("nodes", F.lit(2), F.size("nodes") - 2))
    per = paths.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n_paths"), F.min(F.size("nodes")).alias("least"), F.max(F.size("nodes")).alias("most"), F.avg(F.size("nodes")).alias("mean"),
    )
    between = paths.select("source", "target", inner.alias("x")).groupBy("source", "target").agg(F.countDistinct("x").alias("n_inner"))
    return per.join(between, ["source", "target"])


def removal_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, impact): the square of the degree stands for what a node's removal cuts."""
    return G.degrees(nodes, edges).select("id", "degree", (F.col("degree") * F.col("degree")).alias("impact"))


def critical_paths(nodes: DataFrame, edges: DataFrame, hubs: int = 10, most_nodes: int = 4) -> DataFrame:
    """Paths of three nodes and more, either way along edges, between the ``hubs`` greatest nodes, with the mean degree of what lies between."""
    deg = G.degrees(nodes, edges).select("id", "degree")
    top = deg.orderBy(F.desc("degree"), "id").limit(hubs)  # a report over a fixed number of hubs
    paths = simple_paths(G.undirected(edges), top, most_nodes).where(F.size("nodes") > 2).join(top.select(F.col("id").alias("target")), "target", "left_semi")
    inner = paths.select("source", "target", "nodes", F.explode(F.slice("nodes", F.lit(2), F.size("nodes") - 2)).alias("id"))
    return inner.join(deg, "id").groupBy("source", "target", "nodes").agg(F.avg("degree").alias("importance"))


def measure_overlap(measures: DataFrame, top: int = 10) -> DataFrame:
    """(a < b, common): how many of their ``top`` nodes two measures share. measures: measure, id, value; ties by id."""
    w = W.partitionBy("measure").orderBy(F.desc("value"), "id")
    best = measures.where("value IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("measure", "id")
    names = best.select("measure").distinct()
    pairs = names.select(F.col("measure").alias("a")).join(names.select(F.col("measure").alias("b")), F.col("a") < F.col("b"))
    both = best.select(F.col("measure").alias("a"), "id").join(best.select(F.col("measure").alias("b"), "id"), "id").where("a < b")
    return pairs.join(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")), ["a", "b"], "left").na.fill(0, ["common"])


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(id, community): one level of moves by modularity gain on the undirected graph, all nodes of a round at once.

    In every round each node looks for the neighbouring community with the greatest gain over its
    own (least name on ties); in even rounds only moves to a smaller name are made, in odd ones only to a
    greater, so that two nodes never swap for ever. Gains are whole numbers: 2m links - degree x ends.
    """
    u = G.undirected(edges)
    deg = u.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    ends = u.count()  # twice the edges
    state = cut(nodes.select("id").distinct().join(deg, "id", "left").select("id", F.col("id").alias("community"), F.coalesce("k", F.lit(0)).alias("k")))
    for r in range(rounds):
        total = state.groupBy("community").agg(F.sum("k").alias("ends"))
        to = u.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("links"))
        own = state.select("id", F.col("community").alias("own"), "k")
        cand = to.join(own, "id").join(total, "community")
        gain = F.lit(ends) * F.col("links") - F.col("k") * (F.col("ends") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0))
        cand = cand.withColumn("gain", gain)
        stay = own.join(total.withColumnRenamed("community", "own"), "own").join(to.withColumnRenamed("community", "own"), ["id", "own"], "left")
        stay = stay.select("id", "own", "k", (F.lit(ends) * F.coalesce("links", F.lit(0)) - F.col("k") * (F.col("ends") - F.col("k"))).alias("base"))
        # the greatest gain, of equal ones the least name
        best = cand.where("community <> own").groupBy("id").agg(F.max("gain").alias("top")).join(cand.where("community <> own").select("id", "community", "gain"), "id").where("gain = top")
        best = best.groupBy("id").agg(F.first("top").alias("top"), F.min("community").alias("to"))
        way = F.col("to") < F.col("own") if r % 2 == 0 else F.col("to") > F.col("own")
        state = cut(stay.join(best, "id", "left").select("id", F.when((F.col("top") > F.col("base")) & way, F.col("to")).otherwise(F.col("own")).alias("community"), "k"))
    return state.select("id", "community")


def common_ancestor(a: Column, b: Column) -> Column:
    """Longest common beginning of two path arrays."""
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.coalesce(z["x"] == z["y"], F.lit(False)))
    n = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1
    return F.slice(a, F.lit(1), n.cast("int"))


def steps_between(a: Column, b: Column) -> Column:
    """Steps up and down between two path arrays."""
    return F.size(a) + F.size(b) - 2 * F.size(common_ancestor(a, b))


def circular_layout(ranked: DataFrame, n: int, width: int = 800, height: int = 600) -> DataFrame:
    """x, y of n ranked nodes (rank from 0) on a circle, and on a grid of square shape."""
    side = int(-(-(n**0.5) // 1)) or 1
    angle = F.col("rank") * (2 * 3.141592653589793 / max(n, 1))
    r = min(width, height) / 2 - 50
    return ranked.select(
        "id", "rank", (width / 2 + r * F.cos(angle)).alias("circle_x"), (height / 2 + r * F.sin(angle)).alias("circle_y"),
        (F.pmod("rank", F.lit(side)) * (width / side) + width / side / 2).alias("grid_x"), (F.floor(F.col("rank") / side) * (height / side) + height / side / 2).alias("grid_y"),
    )

"""Communities by modularity: local moves, then contraction of the graph, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import forget, stored

THINNEST = 4  # a round that lowers modularity is tried again with a half, a quarter ... of its moves, this many times


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, weight in both directions, parallel edges added up; an edge from a node to itself counts twice, like any other edge.

    edges: a, b, weight, undirected. Edges without a positive weight are left out.
    """
    rows = edges.where("weight > 0 AND a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.col("weight").cast("double").alias("weight"))
    return (rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
            .groupBy("a", "b").agg(F.sum("weight").alias("weight")))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Share of the weight inside communities minus ``resolution`` times what the degrees alone would put there; 0 without edges.

    graph: as ``both_ways`` gives it. labels: id, label.
    """
    inside = (graph.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
              .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"))
    per = inside.groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("own"))
    r = per.agg(F.sum("total").alias("all"), F.sum("own").alias("own"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    return r["own"] / r["all"] - resolution * r["squares"] / r["all"] ** 2 if r["all"] else 0.0


def _judged(graph: DataFrame, nodes: DataFrame, all_weight: float, resolution: float) -> DataFrame:
    """id, degree, label, own, target: every node with its weight to its own community (loops included) and the neighbouring community that
    it would rather be in, if any. nodes: id, degree, label."""
    totals = nodes.groupBy("label").agg(F.sum("degree").alias("total"), F.count(F.lit(1)).alias("size"))
    loop = F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("loop")
    votes = (graph.join(nodes.select(F.col("id").alias("b"), "label"), "b")
             .groupBy(F.col("a").alias("id"), "label").agg(F.sum("weight").alias("links"), loop))
    # a node's own community is an option without a link too
    options = (votes.unionByName(nodes.select("id", "label", F.lit(0.0).alias("links"), F.lit(0.0).alias("loop")))
               .join(totals, "label").join(nodes.select("id", "degree", F.col("label").alias("mine")), "id"))
    options = (options.groupBy("id", "label").agg(F.sum("links").alias("links"), F.sum("loop").alias("loop"), F.first("total").alias("total"),
                                                  F.first("size").alias("size"), F.first("degree").alias("degree"), F.first("mine").alias("mine")))
    stays = F.col("label") == F.col("mine")
    others = F.col("total") - F.when(stays, F.col("degree")).otherwise(0.0)
    worth = F.round((F.col("links") - F.col("loop") - resolution * F.col("degree") * others / all_weight) / all_weight, 12)
    best = options.groupBy("id").agg(F.max(F.when(stays, F.struct(worth.alias("worth"), F.col("size"), F.col("links")))).alias("here"),
                                     F.min(F.when(~stays, F.struct((-worth).alias("cost"), F.col("label"), F.col("size")))).alias("there"),
                                     F.max("mine").alias("label"), F.max("degree").alias("degree"))
    # of two nodes on their own only the one with the larger label joins the other, or they would change places for ever
    allowed = (F.col("here.size") > 1) | (F.col("there.size") > 1) | (F.col("there.label") < F.col("label"))
    wish = F.when((-F.col("there.cost") - F.col("here.worth") > 1e-12) & allowed, F.col("there.label"))
    return best.select("id", "degree", "label", F.col("here.links").alias("own"), wish.alias("target"))


def _quality(judged: DataFrame, all_weight: float, resolution: float) -> tuple[float, int]:
    """Modularity of the labels, and how many nodes wish to move."""
    per = judged.groupBy("label").agg(F.sum("degree").alias("total"), F.sum("own").alias("own"), F.count("target").alias("wishes"))
    r = per.agg(F.sum("own").alias("own"), F.sum(F.col("total") * F.col("total")).alias("squares"), F.sum("wishes").alias("wishes")).first()
    return r["own"] / all_weight - resolution * r["squares"] / all_weight ** 2, r["wishes"]


def _local_moves(graph: DataFrame, all_weight: float, resolution: float, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """``_judged`` after at most ``rounds`` rounds of moves, every node alone at first, and the modularity. It never falls.

    Two halves of the nodes, chosen by hash, move in turn to where they wish, everybody judging by the labels before the round. Moves
    that get in each other's way can lower modularity; such a round is thrown away and tried with fewer of its moves.
    """
    nodes = graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree")).withColumn("label", F.col("id"))
    judged = stored(_judged(graph, nodes, all_weight, resolution))
    now, wishes = _quality(judged, all_weight, resolution)
    quiet = 0
    for turn in range(rounds):
        if not wishes or quiet == 2:  # both halves had their turn
            break
        gained = 0.0
        for thin in range(THINNEST):
            side = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2 ** (thin + 1)))
            moves = F.when(side == turn % 2, F.col("target"))
            tried = stored(_judged(graph, judged.select("id", "degree", F.coalesce(moves, "label").alias("label")), all_weight, resolution))
            then, left = _quality(tried, all_weight, resolution)
            if then >= now:
                forget(judged)
                gained, judged, now, wishes = then - now, tried, then, left
                break
            forget(tried)
        quiet = quiet + 1 if gained < tolerance else 0
    return judged, now


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 8, rounds: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """id, label: communities of high modularity; a higher ``resolution`` gives smaller ones. The label is the id of one of the members.

    edges: a, b, weight (undirected, ids long). Nodes move between the communities of their neighbours while modularity rises; then every
    community becomes one node and the moves go on among those, until a level brings less than ``tolerance``. Votes are summed per (node,
    community) before the shuffle, so hubs and large communities are combined map-side. Choices are made by hash and ties go to the
    smallest label, so the same edges give the same communities. Nodes without an edge do not appear.
    """
    graph = stored(both_ways(edges))
    all_weight = graph.agg(F.sum("weight")).first()[0]
    if not all_weight:
        return graph.select(F.col("a").alias("id"), F.col("a").alias("label"))
    members, before = None, None
    for _ in range(levels):
        judged, now = _local_moves(graph, all_weight, resolution, rounds, tolerance)
        step = judged.select(F.col("id").alias("label"), F.col("label").alias("up"))
        if members is None:
            members = stored(step.toDF("id", "label"))
        else:
            below, members = members, stored(members.join(step, "label").select("id", F.col("up").alias("label")))
            forget(below)
        last = before is not None and now - before < tolerance
        before = now
        if not last:
            below, graph = graph, stored(graph.join(step.toDF("a", "la"), "a").join(step.toDF("b", "lb"), "b")
                                         .groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("weight").alias("weight")))
            forget(below)
        forget(judged)
        if last:
            break
    forget(graph)
    return members

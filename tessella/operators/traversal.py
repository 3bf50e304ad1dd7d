"""Traversals: reachability, signed hops, lineage nodes, edges and simple paths.

Sets of nodes and edges come from breadth-first rounds whose state is one row a node, stored between rounds so that a
lost executor costs one round. Paths are enumerated only for path queries, where their number is the result's size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.upsert import numbered
from tessella.plans.graph import EDGE_KEY, UNLIMITED, Graph
from tessella.session import materialize


def rounds(seeds: DataFrame, onward: Callable[[DataFrame], DataFrame], by: list[str], most: int | None) -> DataFrame:
    """by, cur, depth: the least number of steps from each seed row to every node, at most `most` of them.

    onward gives the steps from a frontier of the columns by and cur, to next.
    """
    seen = [materialize(seeds.withColumn("depth", F.lit(0)), "round")]
    while most is None or len(seen) <= most:
        known = reduce(DataFrame.unionByName, seen).select(*by, "cur")
        ahead = onward(seen[-1].select(*by, "cur")).select(*by, F.col("next").alias("cur"))
        fresh = materialize(ahead.distinct().join(known, [*by, "cur"], "left_anti").withColumn("depth", F.lit(len(seen))), "round")
        if not fresh.limit(1).count():
            break
        seen.append(fresh)
    return reduce(DataFrame.unionByName, seen)


def reachable(graph: Graph, start: str, direction: str = "downstream", depth: int = UNLIMITED) -> DataFrame:
    """id, depth: the nodes that can be reached from start, start included."""
    seed = graph.target(start).select(F.col("id").alias("cur"))
    return rounds(seed, lambda frontier: graph.onward(frontier, direction), [], depth or None).select(F.col("cur").alias("id"), "depth")


def hops(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """id, hop: signed distance, up to depth + 1 steps; a tie of both directions stays upstream, the target is 0."""
    most = depth + 1 if depth else UNLIMITED
    up = reachable(graph, target, "upstream", most).select("id", (-F.col("depth")).alias("hop"))
    down = reachable(graph, target, "downstream", most).select("id", F.col("depth").alias("hop"))
    return up.unionByName(down).groupBy("id").agg(F.min_by("hop", F.struct(F.abs("hop"), "hop")).alias("hop"))


def lineage_nodes(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """The nodes with their hop."""
    return graph.nodes.join(hops(graph, target, depth), "id")


def node_list(nodes: DataFrame, name: str = "place") -> DataFrame:
    """Lineage nodes with their place by hop, then label in the order of languages, then id."""
    keyed = nodes.withColumn("_label", F.collate(F.coalesce("label", "id"), "UNICODE"))
    return numbered(keyed, [], ["hop", "_label", "id"], name).drop("_label")


def edge_list(edges: DataFrame, nodes: DataFrame, name: str = "place") -> DataFrame:
    """Edges with their place by the label of the node they leave, in the order of languages, then by their ends."""
    named = edges.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("_from")), "src", "left")
    keyed = named.withColumn("_from", F.collate(F.coalesce("_from", "src"), "UNICODE"))
    return numbered(keyed, [], ["_from", "src", "dst", "relation"], name).drop("_from")


def lineage_edges(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """src, dst, relation of the edges that some simple walk from the target takes.

    Away from the target, u -> v is taken if a path of at most `depth` steps reaches u without v. A shortest path does
    unless v is nearer to the target than u, so only such edges ask for a search that avoids v; one search a v.
    """
    taken = []
    for direction in ("upstream", "downstream"):
        near = materialize(reachable(graph, target, direction, depth), "near")
        at = graph.onward(near.select(F.col("id").alias("cur"), F.col("depth").alias("from_depth")), direction)
        at = at.where((F.col("cur") != F.col("next")) & (F.col("next") != target))
        both = at.join(near.select(F.col("id").alias("next"), F.col("depth").alias("to_depth")), "next", "left")
        back = F.col("to_depth").isNotNull() & (F.col("to_depth") < F.col("from_depth"))
        both = materialize(both.withColumn("back", back), "steps")
        taken.append(both.where(~F.col("back")).select(*EDGE_KEY))
        avoided = both.where("back").select(F.col("next").alias("avoided")).distinct()
        if avoided.isEmpty():
            continue
        seeds = avoided.withColumn("cur", F.lit(target))
        # Such a search stays among the nodes of near, so the steps found from them are all that it needs.
        steps = both.select("cur", "next")
        free = rounds(seeds, lambda frontier: frontier.join(steps, "cur").where(F.col("next") != F.col("avoided")), ["avoided"], depth or None)
        kept = both.where("back").join(free.select(F.col("avoided").alias("next"), "cur"), ["next", "cur"], "left_semi")
        taken.append(kept.select(*EDGE_KEY))
    return reduce(DataFrame.unionByName, taken).distinct()


def maximal_paths(graph: Graph, target: str, direction: str, depth: int = UNLIMITED) -> DataFrame:
    """path, ord: simple paths from the target that cannot go on, in depth-first order of ord.

    With a depth, paths that go on beyond it are left out, not cut. Parallel edges give a path each.
    """
    first = graph.target(target).select(F.array("id").alias("path"), F.array().cast("array<string>").alias("ord"))
    frontier, ended, level = first, [], 0
    while depth == UNLIMITED or level <= depth:
        onward = graph.onward(frontier.withColumn("cur", F.element_at("path", -1)), direction).where(~F.array_contains("path", F.col("next")))
        onward = materialize(onward.select("path", "ord", "next", "key"), "paths")
        if level:
            ended.append(frontier.join(onward.select("ord").distinct(), "ord", "left_anti").select("path", "ord"))
        if not onward.limit(1).count():
            break
        frontier = onward.select(F.concat("path", F.array("next")).alias("path"), F.concat("ord", F.array("key")).alias("ord"))
        level += 1
    return reduce(DataFrame.unionByName, ended) if ended else first.limit(0)


def lineage_paths(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """direction, path, ord of both directions."""
    return reduce(DataFrame.unionByName, [maximal_paths(graph, target, d, depth).withColumn("direction", F.lit(d)) for d in ("upstream", "downstream")])


def lineage_stats(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """One row: node_count, edge_count, max_hop."""
    nodes = hops(graph, target, depth).agg(F.count("*").alias("node_count"), F.max(F.abs("hop")).alias("max_hop"))
    return nodes.crossJoin(lineage_edges(graph, target, depth).agg(F.count("*").alias("edge_count")))  # one row each

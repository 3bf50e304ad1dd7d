"""Traces: maximal paths as labels, without those contained in longer ones, ranked and capped; and one-hop impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import contains_run, format_label
from tessella.operators.ranking import label_score
from tessella.operators.traversal import maximal_paths
from tessella.plans.graph import UNLIMITED, Graph
from tessella.session import materialize

#: Depth-first leaves and listed traces of a direction when depth is bounded; edges and paths of an impact.
LEAVES, LISTED, IMPACT_PATHS, IMPACT_EDGES = 40, 12, 40, 200


def labelled(graph: Graph, paths: DataFrame) -> DataFrame:
    """Add labels, the path as node labels with file names."""
    named = graph.nodes.select("id", format_label(F.col("label"), F.col("file")).alias("name"))
    each = paths.select("ord", F.posexplode("path").alias("at", "id")).join(named, "id")
    labels = each.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("labels"))
    return paths.join(labels, "ord")


def without_contained(paths: DataFrame) -> DataFrame:
    """paths whose labels do not stand as one run inside longer labels. Meets by first label and size, not all pairs."""
    distinct = paths.select("labels").distinct()
    starts = distinct.select(F.col("labels").alias("longer"), F.posexplode("labels").alias("at", "head")).withColumn("rest", F.size("longer") - F.col("at"))
    short = distinct.select(F.col("labels").alias("shorter"), F.col("labels")[0].alias("head"))
    inside = starts.join(short, "head").where((F.size("longer") > F.size("shorter")) & (F.size("shorter") <= F.col("rest")) & contains_run(F.col("longer"), F.col("shorter")))
    return paths.join(inside.select(F.col("shorter").alias("labels")).distinct(), "labels", "left_anti")


def traces(graph: Graph, target: str, depth: int = UNLIMITED) -> DataFrame:
    """direction, labels, path, ord, rank: rank counts the listed traces of a direction; null ones are known but unlisted.

    With a depth: the first LEAVES leaves in depth-first order, of which the best LISTED are listed. Without one all
    are, in depth-first order.
    """
    out = []
    for direction in ("upstream", "downstream"):
        paths = maximal_paths(graph, target, direction, depth)
        if depth:
            paths = paths.orderBy("ord").limit(LEAVES)
        kept = without_contained(materialize(labelled(graph, paths), "traces"))
        if direction == "upstream":
            kept = kept.withColumn("labels", F.reverse("labels"))
        kept = kept.withColumn("direction", F.lit(direction))
        best = [F.desc(label_score(F.col("labels"))), F.desc(F.size("labels")), F.col("ord")] if depth else [F.col("ord")]
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(*best)))
        out.append(ranked.withColumn("rank", F.when(F.col("rank") <= LISTED, F.col("rank"))) if depth else ranked)
    return reduce(DataFrame.unionByName, out)


def trace_nodes(found: DataFrame, target: DataFrame) -> DataFrame:
    """id of every node on a trace, listed or not, and of the target."""
    return found.select(F.explode("path").alias("id")).unionByName(target.select("id")).distinct()


def impact_nodes(graph: Graph, target: str) -> DataFrame:
    """direction, id: known neighbours one step away."""
    up = graph.edges.where(F.col("dst") == target).select(F.lit("upstream").alias("direction"), F.col("src").alias("id"))
    down = graph.edges.where(F.col("src") == target).select(F.lit("downstream").alias("direction"), F.col("dst").alias("id"))
    return up.unionByName(down).distinct().join(graph.nodes.select("id"), "id", "left_semi")


def impact_edges(graph: Graph, target: str) -> DataFrame:
    """The first IMPACT_EDGES edges at the target, incoming ones first."""
    at = graph.edges.where((F.col("src") == target) | (F.col("dst") == target))
    both = F.explode(F.array_compact(F.array(F.when(F.col("dst") == target, 0), F.when(F.col("src") == target, 1))))
    return at.withColumn("side", both).orderBy("side", "src", "dst", "relation").limit(IMPACT_EDGES)


def impact_paths(graph: Graph, target: str, depth: int = 3) -> DataFrame:
    """The first IMPACT_PATHS listed traces at depth + 2, upstream ones first."""
    side = F.when(F.col("direction") == "upstream", 0).otherwise(1)
    return traces(graph, target, (depth or 3) + 2).where(F.col("rank").isNotNull()).orderBy(side, "rank").limit(IMPACT_PATHS)

"""Filters of a lineage: by concern, direction, one path, and helpers at the rim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.neighbours import degrees
from tessella.operators.traversal import reachable, rounds
from tessella.plans.graph import Graph

#: Relations of each concern: fixed values.
CONCERNS = {"http": ["HANDLES"], "writes": ["WRITES"], "reads": ["READS"], "kafka": ["PUBLISHES", "CONSUMED_BY"]}
SURFACES = ("http_endpoint", "database_table", "event_topic")


def _closure(graph: Graph, starts: DataFrame, direction: str) -> DataFrame:
    """id: all nodes that can be reached from any of the starts, these included."""
    return rounds(starts.select(F.col("id").alias("cur")).distinct(), lambda frontier: graph.onward(frontier, direction), [], None).select(F.col("cur").alias("id"))


def concern_nodes(lineage: Graph, target: str, concern: str) -> DataFrame:
    """id of the nodes on walks from the target over an edge of the concern, either way; all nodes for "all"."""
    if concern not in CONCERNS:
        return lineage.nodes.select("id")
    wanted = lineage.edges.where(F.upper("relation").isin(CONCERNS[concern]))
    parts = [lineage.nodes.where(F.col("id") == target).select("id")]
    for direction, near, far in (("downstream", "src", "dst"), ("upstream", "dst", "src")):
        around = reachable(lineage, target, direction).select("id")
        hit = wanted.join(around.select(F.col("id").alias(near)), near, "left_semi")
        back = _closure(lineage, hit.select(F.col(near).alias("id")), "upstream" if direction == "downstream" else "downstream")
        parts += [around.join(back, "id", "left_semi"), hit.select(F.col(far).alias("id"))]
    return reduce(DataFrame.unionByName, parts).distinct()


def direction_nodes(hops: DataFrame, direction: str) -> DataFrame:
    """Rows whose hop lies on that side; the target lies on both."""
    return hops.where({"upstream": F.col("hop") <= 0, "downstream": F.col("hop") >= 0}.get(direction, F.lit(True)))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def isolated(edges: DataFrame, path: list[str]) -> DataFrame:
    """Edges between neighbours on the path, either way."""
    pairs = [(a, b) for a, b in zip(path, path[1:], strict=False)]
    wanted = edges.sparkSession.createDataFrame(sorted({*pairs, *((b, a) for a, b in pairs)}) or [("", "")], "src string, dst string")
    return edges.join(wanted, ["src", "dst"], "left_semi").select(edges.columns)


def without_helpers(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Nodes without those of at most one edge end that are neither the target nor a surface; one pass."""
    counted = nodes.join(degrees(edges), "id", "left")
    return counted.where((F.col("id") == target) | F.col("kind").isin(*SURFACES) | (F.coalesce("degree", F.lit(0)) > 1)).select(nodes.columns)


def reprojected(paths: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths without hidden nodes, if two or more are left and all neighbours still share an edge."""
    each = paths.select("direction", "ord", F.posexplode("path").alias("at", "id")).join(ids.select("id"), "id", "left_semi")
    shown = each.groupBy("direction", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("path")).where(F.size("path") > 1)
    steps = shown.select("direction", "ord", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.struct(F.element_at("path", i - 1).alias("a"), F.element_at("path", i).alias("b")))).alias("at", "step")).select("direction", "ord", F.least("step.a", "step.b").alias("a"), F.greatest("step.a", "step.b").alias("b"))
    joined = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    broken = steps.join(joined, ["a", "b"], "left_anti").select("direction", "ord").distinct()
    return shown.join(broken, ["direction", "ord"], "left_anti")

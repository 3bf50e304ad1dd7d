"""One-step queries: search, symbol list, point lookup, callers, callees, the provenance report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import plain_label
from tessella.plans.graph import Graph


def search(graph: Graph, needle: str, limit: int = 20) -> DataFrame:
    """The first nodes by id with needle in label, plain label, id or file, ignoring case; all for an empty one."""
    low = needle.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    hit = has(F.col("label")) | has(plain_label(F.col("label"))) | has(F.col("id")) | has(F.col("file")) if low else F.lit(True)
    return graph.nodes.where(hit).orderBy("id").limit(limit)


def symbols(graph: Graph, limit: int = 500) -> DataFrame:
    """The first nodes by label, then file."""
    return graph.nodes.orderBy("label", F.coalesce("file", F.lit("")), "id").limit(limit)


def node(graph: Graph, target: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == target)


def callers(graph: Graph, target: str, limit: int = 50) -> DataFrame:
    """The first edges into target with their node's columns (null if it is unknown)."""
    return _beside(graph, F.col("dst") == target, "src", limit)


def callees(graph: Graph, target: str, limit: int = 50) -> DataFrame:
    return _beside(graph, F.col("src") == target, "dst", limit)


def _beside(graph: Graph, at: Column, other: str, limit: int) -> DataFrame:
    edges = graph.edges.where(at).orderBy("src", "dst", "relation").limit(limit)
    named = graph.nodes.select(F.col("id").alias(other), "label", "kind", "file", F.col("line").alias("node_line"))
    return edges.join(named, other, "left")


def provenance_report(graph: Graph) -> DataFrame:
    """Edges with names for ids, where there are some: proven by a place in the source or not, rule, confidence, certainty.

    Every rule proves what it says, so the confidence is always 1; an edge that may not be taken says so by certainty.
    """
    held = set(graph.edges.columns)
    rule = F.col("rule") if "rule" in held else F.lit(None).cast("string")
    proven = F.size("evidence") > 0 if "evidence" in held else F.col("line").isNotNull()
    name = lambda side: graph.nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_name"))
    out = graph.edges.withColumns({"_rule": rule, "_proven": proven}).join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return out.select(F.coalesce("src_name", "src").alias("from_name"), F.coalesce("dst_name", "dst").alias("to_name"), "relation", "certainty", F.col("_rule").alias("derivation"), F.col("_proven").alias("proven"), F.lit(1).alias("confidence"))


def kind_counts(graph: Graph) -> DataFrame:
    """kind, n, place: nodes of each kind in the legend's order, known kinds first."""
    known = ["http_endpoint", "database_table", "event_topic", "module", "class", "interface", "method", "function"]
    counts = graph.nodes.groupBy(F.lower("kind").alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.array_position(F.array(*map(F.lit, known)), F.col("kind")).cast("int")).withColumn("place", F.when(F.col("place") > 0, F.col("place")).otherwise(len(known) + 1))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: ends of edges at each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

"""Surface impact: the endpoints, tables and topics inside a lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import endpoint, format_label
from tessella.plans.graph import Graph


def evidence(file: Column, line: Column) -> Column:
    """file:line of a node, "?" for an unknown line; null without a file."""
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(file, F.lit(":"), F.coalesce(line.cast("string"), F.lit("?"))))


def surface_endpoints(graph: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, method, path, handler of the endpoints whose label is one; handler: the first node that handles it."""
    named = graph.nodes.select(F.col("id").alias("dst"), format_label(F.col("label"), F.col("file")).alias("name"))
    first = edges.where(F.upper("relation") == "HANDLES").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst")).join(named, "dst", "left")
    own = nodes.where(F.col("kind") == "http_endpoint").withColumn("endpoint", endpoint(F.col("label"))).where(F.col("endpoint").isNotNull())
    return own.join(first.select("id", F.coalesce("name", F.lit("?")).alias("handler")), "id", "left").select("id", "endpoint.method", "endpoint.path", F.coalesce("handler", "label").alias("handler"))


def surface_tables(graph: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, via: who reads or writes the table, or its own label."""
    return _via(graph, nodes.where(F.col("kind") == "database_table"), edges.where(F.upper("relation").isin("READS", "WRITES"))).withColumn("via", F.coalesce("via", F.array("label"))).select("id", F.col("label").alias("name"), "via")


def surface_publishes(graph: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, topic, via of the topics with a publisher inside the lineage."""
    return _via(graph, nodes.where(F.col("kind") == "event_topic"), edges.where(F.upper("relation") == "PUBLISHES")).where(F.col("via").isNotNull()).select("id", F.col("label").alias("topic"), "via")


def surface_consumes(graph: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, topic, consumer, callback of each consumer of a topic of the lineage."""
    named = graph.nodes.select(F.col("id").alias("dst"), F.col("label").alias("callback"), format_label(F.col("label"), F.col("file")).alias("consumer"))
    used = edges.where(F.upper("relation") == "CONSUMED_BY").select(F.col("src").alias("id"), "dst").join(named, "dst", "left")
    return nodes.where(F.col("kind") == "event_topic").select("id", F.col("label").alias("topic")).join(used, "id").select("id", "topic", F.coalesce("consumer", F.lit("?")).alias("consumer"), "callback")


def _via(graph: Graph, own: DataFrame, edges: DataFrame) -> DataFrame:
    named = graph.nodes.select(F.col("id").alias("src"), format_label(F.col("label"), F.col("file")).alias("name"))
    who = edges.join(named, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("src", "relation", F.coalesce("name", F.lit("?")).alias("name")))).alias("all"))
    return own.join(who.select("id", F.transform("all", lambda x: x["name"]).alias("via")), "id", "left")

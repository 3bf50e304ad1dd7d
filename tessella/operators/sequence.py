"""Call sequences: messages in source order, with asynchronous segments after published topics.

An item is an occurrence of an edge out of a node; items are numbered by occurrence order (else the line, else last),
ties by edge. A scope expands depth first: every item is a message, and its node is expanded unless it stands on the
way down (the root does not count) or the edge is asynchronous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.upsert import numbered
from tessella.plans.graph import Graph
from tessella.session import materialize

ASYNC = ("PUBLISHES", "CONSUMED_BY")
LAST = 2**53 - 1


def call_items(edges: DataFrame) -> DataFrame:
    """src, item, dst, relation, certain: the numbered items of every node, one an occurrence or an edge without any."""
    if "occurrences" in edges.columns:
        edges = edges.select("src", "dst", "relation", "certainty", "line", F.explode_outer("occurrences").alias("o")).withColumn("call_order", F.col("o.order"))
    order = F.coalesce(F.col("call_order"), F.col("line")).cast("long")
    by = Window.partitionBy("src").orderBy(F.coalesce(order, F.lit(LAST)), "dst", "relation")
    return edges.withColumn("item", F.row_number().over(by)).select("src", "item", "dst", "relation", (F.col("certainty") != "POSSIBLE").alias("certain"))


def scopes(items: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """segment, step (array<int>), src, dst, relation, certain: the messages of all segments, a round a call's depth.

    starts: segment, cur, prefix. Rounds end when no segment goes on: a node is not expanded below itself.
    """
    start = starts.select("segment", "cur", "prefix", F.array().cast("array<string>").alias("visited"))
    steps = items.withColumnRenamed("src", "cur")
    out: list[DataFrame] = []
    while depth is None or len(out) < depth:
        level = start.join(steps, "cur").withColumn("step", F.concat("prefix", F.array("item")))
        level = materialize(level.select("segment", "cur", "step", "visited", "dst", "relation", "certain"), "scope")
        out.append(level.select("segment", "step", F.col("cur").alias("src"), "dst", "relation", "certain"))
        if not level.limit(1).count():
            break
        onward = level.where(~F.upper("relation").isin(*ASYNC) & ~F.array_contains("visited", F.col("dst")))
        start = onward.select("segment", F.col("dst").alias("cur"), F.col("step").alias("prefix"), F.concat("visited", F.array("dst")).alias("visited"))
    return reduce(DataFrame.unionByName, out)


def sequence(graph: Graph, root: str, *, depth: int | None = None) -> DataFrame:
    """segment, number, step, src, dst, relation, certain: segment 0 is the root's, others one a (topic, consumer).

    Segments follow the publishing messages; consumers of one topic follow each other by edge. What a consumer
    publishes opens no further segment. All segments grow together; without a depth until none goes on.
    """
    items = materialize(call_items(graph.edges), "items")
    start = items.sparkSession.createDataFrame([(0, root, [])], "segment int, cur string, prefix array<int>")
    main = materialize(scopes(items, start, depth), "messages")
    published = main.where(F.upper("relation") == "PUBLISHES").select("step", F.col("dst").alias("topic"))
    consumed = graph.edges.where(F.upper("relation") == "CONSUMED_BY").select(F.col("src").alias("topic"), F.col("dst").alias("consumer"), (F.col("certainty") != "POSSIBLE").alias("certain"))
    queue = published.join(consumed, "topic").groupBy("topic", "consumer").agg(F.min("step").alias("at"), F.min("certain").alias("certain"))
    queue = materialize(numbered(queue, [], ["at", "consumer"], "segment"), "segments")
    first = F.array(F.lit(1))
    heads = queue.select("segment", first.alias("step"), F.col("topic").alias("src"), F.col("consumer").alias("dst"), F.lit("CONSUMED_BY").alias("relation"), "certain")
    below = scopes(items, queue.select("segment", F.col("consumer").alias("cur"), first.alias("prefix")), depth)
    return numbered(main.unionByName(heads).unionByName(below), ["segment"], ["step"], "number")


def participants(graph: Graph, messages: DataFrame, root: str) -> DataFrame:
    """id, place: known nodes by first appearance, the root first."""
    seen = messages.select(F.posexplode(F.array("src", "dst")).alias("end", "id"), "segment", "number")
    first = seen.groupBy("id").agg(F.min(F.struct("segment", "number", "end")).alias("at"))
    start = graph.nodes.where(F.col("id") == root).select("id", F.struct(F.lit(-1).alias("segment"), F.lit(0).alias("number"), F.lit(0).alias("end")).alias("at"))
    both = first.unionByName(start).groupBy("id").agg(F.min("at").alias("at")).join(graph.nodes.select("id"), "id", "left_semi")
    return numbered(both, [], ["at"], "place").select("id", "place")

"""Operators over ranked lineage paths: paths through a node, columns of a layout, highlights, edges between neighbours.

paths: direction, path (from the target outwards), place (the rank of the path within its direction, from 1).
Upstream paths rank before downstream ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank() -> Column:
    return F.struct(F.when(F.col("direction") == "upstream", 0).otherwise(1).alias("side"), F.col("place").alias("place"))


def shown(direction: Column, path: Column) -> Column:
    """A path as it reads: upstream ones end at the target."""
    return F.when(direction == "upstream", F.reverse(path)).otherwise(path)


def best_through(paths: DataFrame) -> DataFrame:
    """id, path: for each node the longest path that holds it, the first of equals, as it reads."""
    each = paths.select("direction", "path", "place", F.explode("path").alias("id"))
    best = F.min_by(F.struct("direction", "path"), F.struct(-F.size("path"), _rank()))
    return each.groupBy("id").agg(best.alias("b")).select("id", shown(F.col("b.direction"), F.col("b.path")).alias("path"))


def default_path(paths: DataFrame) -> DataFrame:
    """One row, path: the first downstream path, else the first upstream one, as it reads."""
    order = F.struct(F.when(F.col("direction") == "downstream", 0).otherwise(1), "place")
    best = paths.groupBy().agg(F.min_by(F.struct("direction", "path"), order).alias("b")).where("b IS NOT NULL")
    return best.select(shown(F.col("b.direction"), F.col("b.path")).alias("path"))


def highlighted(paths: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """id of the nodes, and src, dst of the steps, on the paths that hold the node."""
    hit = paths.where(F.array_contains("path", node))
    ids = hit.select(F.explode("path").alias("id")).distinct()
    steps = F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.struct(F.element_at("path", i - 1).alias("src"), F.element_at("path", i).alias("dst")))
    return ids, hit.where(F.size("path") > 1).select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct()


def path_depths(paths: DataFrame) -> DataFrame:
    """id, depth: the signed place of a node on a path where it is farthest from the target, the first of equals."""
    each = paths.select("direction", "place", F.posexplode("path").alias("at", "id"))
    signed = each.withColumn("depth", F.when(F.col("direction") == "upstream", -F.col("at")).otherwise(F.col("at")))
    return signed.groupBy("id").agg(F.min_by("depth", F.struct(-F.abs("depth"), _rank())).alias("depth"))


def layout_columns(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """id, column: a node's depth on the paths, else its hop. nodes: id, hop."""
    return nodes.select("id", "hop").join(path_depths(paths), "id", "left").select("id", F.coalesce("depth", "hop").alias("column"))


def column_ranks(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """id, column, row: nodes of a column in the order in which the paths meet them, others by label after them."""
    each = paths.select(_rank().alias("rank"), F.posexplode(shown(F.col("direction"), F.col("path"))).alias("at", "id"))
    met = each.groupBy("id").agg(F.min(F.struct("rank", "at")).alias("met"))
    placed = layout_columns(nodes, paths).join(met, "id", "left").join(nodes.select("id", "label"), "id")
    by = Window.partitionBy("column").orderBy(F.asc_nulls_last("met"), "label", "id")
    return placed.select("id", "column", F.row_number().over(by).alias("row"))


def lanes(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """src, dst, relation, lane: edges out of a node by the row of their other end, from 0. rows: id, row."""
    at = edges.join(rows.select(F.col("id").alias("dst"), "row"), "dst").join(rows.select(F.col("id").alias("src")), "src", "left_semi")
    return at.select("src", "dst", "relation", (F.row_number().over(Window.partitionBy("src").orderBy("row", "dst", "relation")) - 1).alias("lane"))


def edges_between(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, relation: the first edge of each step, "calls" if there is none."""
    first = edges.groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    return steps.join(first, ["src", "dst"], "left").select("src", "dst", F.coalesce("relation", F.lit("calls")).alias("relation"))


def trace_step(path: Column, node: Column) -> Column:
    """The place of a node on a path, from 1; null if it is not on it."""
    at = F.array_position(path, node)
    return F.when(at > 0, at)


def message_rows(messages: DataFrame) -> DataFrame:
    """segment, number, row: the running number of a message over all segments, with a row for each divider."""
    counts = messages.groupBy("segment").agg(F.count("*").alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("segment", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("segment")).alias("start"))
    return messages.join(starts, "segment").select("segment", "number", (F.col("start") + F.col("number")).alias("row"))


def topic_flows(edges: DataFrame) -> DataFrame:
    """publisher, topic, consumer: who publishes what and who consumes it."""
    sent = edges.where(F.upper("relation") == "PUBLISHES").select(F.col("src").alias("publisher"), F.col("dst").alias("topic"))
    return sent.join(edges.where(F.upper("relation") == "CONSUMED_BY").select(F.col("src").alias("topic"), F.col("dst").alias("consumer")), "topic")

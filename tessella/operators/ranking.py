"""Scores and orders of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import basename, plain_label
from tessella.plans.graph import Graph


def node_score(label: Column, file: Column) -> Column:
    """What a node adds to its path beside 1: layers of a service by its file, less for start-up code."""
    path = F.lower(F.regexp_replace(F.coalesce(file, F.lit("")), r"\\", "/"))
    name, plain = basename(path), F.lower(plain_label(label))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        points(path.rlike("/routes?/|router"), 5)
        + points(path.rlike("controller|handler"), 4)
        + points(path.rlike("/services?/"), 2)
        + points(path.rlike("/(repositories|repository|dao)/"), 1)
        + points(name.rlike(r"^(app|main|bootstrap)\.[tj]s\z") & plain.rlike("^(build|create|bootstrap|setup)"), -4)
        + points(name.rlike(r"^server\.[tj]s\z") & plain.isin("server", "main", "listen"), -1)
    )


def label_score(path: Column) -> Column:
    """A score of a path of labels: its length and what they say."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    one = lambda s: points(F.lower(s).contains("route"), 3) + points(F.lower(s).rlike("controller|handler"), 2) + points(F.lower(s).rlike("buildapp|bootstrap|createapp"), -3)
    return F.size(path) + F.aggregate(F.transform(path, one), F.lit(0), lambda a, x: a + x)


def score_paths(graph: Graph, paths: DataFrame) -> DataFrame:
    """Add score: a point for each known node of the path and its node_score. paths: direction, path, ord."""
    points = graph.nodes.select("id", (1 + node_score(F.col("label"), F.col("file"))).alias("points"))
    each = paths.select("direction", "ord", F.explode("path").alias("id")).join(points, "id")
    sums = each.groupBy("direction", "ord").agg(F.sum("points").cast("int").alias("score"))
    return paths.join(sums, ["direction", "ord"], "left").withColumn("score", F.coalesce("score", F.lit(0)))




def rank_order() -> list[Column]:
    return [F.desc("score"), F.desc(F.size("path")), F.when(F.col("direction") == "upstream", 0).otherwise(1), F.col("ord")]


def rank_paths(graph: Graph, paths: DataFrame) -> DataFrame:
    return score_paths(graph, paths).orderBy(*rank_order())


def best_path(graph: Graph, paths: DataFrame) -> DataFrame:
    """The first path of each direction."""
    scored = score_paths(graph, paths)
    key = F.struct(-F.col("score"), -F.size("path"), "ord")
    return scored.groupBy("direction").agg(F.min_by(F.struct("path", "score"), key).alias("best")).select("direction", "best.path", "best.score")

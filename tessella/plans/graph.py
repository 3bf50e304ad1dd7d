"""The property graph: nodes and edges as DataFrames.

nodes: id, label, kind, file, line. edges: src, dst, relation, certainty, line, order; one edge a (src, dst, relation).
Edges stand in the order of these three columns, so "first" and "depth first" are defined without a global numbering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

UNLIMITED = 0
EDGE_KEY = ["src", "dst", "relation"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def stored(self) -> Graph:
        """The same graph written once, for queries that read it in many rounds."""
        return Graph(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"))

    def onward(self, frontier: DataFrame, direction: str) -> DataFrame:
        """frontier (with a column cur) and next, key and the edge of each step from cur that ends at a known node.

        key orders the steps of one node. The frontier meets the edges first, so a round shuffles what it reaches and
        not the graph: a frontier whose stored size is small is broadcast to the scan of the edges.
        """
        ends = ("dst", "src") if direction == "upstream" else ("src", "dst")
        steps = self.edges.select(F.col(ends[0]).alias("cur"), F.col(ends[1]).alias("next"), step_key(F.col(ends[1]), F.col("relation")).alias("key"), *EDGE_KEY)
        # An inner join: Catalyst would push a semi-join below the first one, back to all edges.
        return frontier.join(steps, "cur").join(self.nodes.select(F.col("id").alias("next")).distinct(), "next")

    def target(self, target: str) -> DataFrame:
        """The node's row; an error if there is none."""
        found = self.nodes.where(F.col("id") == target)
        if not found.limit(1).count():
            raise KeyError(f"node not found: {target}")
        return found


def step_key(other: Column, relation: Column) -> Column:
    return F.concat(other, F.lit("\x00"), relation)

"""The facade: analyze a source tree, load a graph, and ask it everything the queries can answer."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import filters, neighbours, ranking, sequence, surfaces, traces, traversal
from tessella.plans.graph import UNLIMITED, Graph
from tessella.plans.resolution import resolve
from tessella.plans.rules import Built, build
from tessella.session import materialize
from tessella.sources.facts import parse_files, summary
from tessella.sources.graph_json import as_graph, read_graph
from tessella.sources.tree import scan

#: Where a graph document is looked for below a project's root, in order, unless $TESSELLA_GRAPH names one.
PLACES = ("graph.json", "generated/graph.json", "out/graph.json", "analysis/graph.json")


@dataclass(frozen=True)
class Analysis:
    """A tree's parsed files (skipped ones with their problem), the built graph, and a summary of its facts."""

    parsed: DataFrame
    built: Built
    took: dict[str, float] = field(default_factory=dict)

    @property
    def statistics(self) -> dict[str, float]:
        """Endpoints, tables, topics and unresolved calls, and the milliseconds of parsing, building and both."""
        counts = {r["type"]: r["n"] for r in self.built.nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}  # a row a kind of node
        found = {name: counts.get(kind, 0) for name, kind in (("endpoints", "HTTP_ENDPOINT"), ("tables", "DATABASE_TABLE"), ("topics", "EVENT_TOPIC"))}
        return found | {"unresolved": self.built.unresolved.count()} | self.took

    @property
    def skipped(self) -> DataFrame:
        return self.parsed.where("problem IS NOT NULL").select("file", "problem")

    @property
    def summary(self) -> DataFrame:
        return summary(self.parsed)


def analyze(spark: SparkSession, root: str) -> Analysis:
    """Scan, parse, resolve and build; files that cannot be read are skipped as a whole."""
    began = time.monotonic()
    parsed = materialize(parse_files(scan(spark, root)), "parsed")
    read = time.monotonic()
    built = build(resolve(parsed))
    built = Built(*[materialize(df, "built") for df in (built.nodes, built.edges, built.unresolved)])
    ended = time.monotonic()
    return Analysis(parsed, built, {"parse_ms": 1000 * (read - began), "build_ms": 1000 * (ended - read), "total_ms": 1000 * (ended - began)})


def source_root(root: str, path: str, known: dict[str, str] | None = None) -> str:
    """Where the sources of a graph document lie: $TESSELLA_SOURCE_ROOT, else the folder of the first part of the path
    that is known, if it exists, else the project's root. known: parts of paths, in lower case, and folders below root.
    """
    if named := os.environ.get("TESSELLA_SOURCE_ROOT"):
        if not Path(named).exists():
            raise FileNotFoundError(f"TESSELLA_SOURCE_ROOT does not exist: {named}")
        return named
    plain = os.path.normpath(path).lower()
    for part, folder in (known or {}).items():
        if os.path.normpath(part) in plain and Path(root, folder).exists():
            return str(Path(root, folder))
    return root


def graph_path(root: str) -> str:
    """The graph document of a project; an error if there is none."""
    if named := os.environ.get("TESSELLA_GRAPH"):
        return named
    for place in PLACES:
        if (found := Path(root, place)).exists():
            return str(found)
    raise FileNotFoundError(f"no graph document below {root}")


@dataclass(frozen=True)
class Lineage:
    """A target's neighbourhood: nodes with their hop, edges, ranked paths and one row of statistics."""

    graph: Graph
    target: str
    depth: int

    @cached_property
    def nodes(self) -> DataFrame:
        return materialize(traversal.lineage_nodes(self.graph, self.target, self.depth), "lineage-nodes")

    @cached_property
    def edges(self) -> DataFrame:
        taken = traversal.lineage_edges(self.graph, self.target, self.depth)
        return materialize(self.graph.edges.join(taken, ["src", "dst", "relation"], "left_semi").select(self.graph.edges.columns), "lineage-edges")

    @property
    def paths(self) -> DataFrame:
        return ranking.rank_paths(self.graph, traversal.lineage_paths(self.graph, self.target, self.depth))

    @property
    def stats(self) -> DataFrame:
        return traversal.lineage_stats(self.graph, self.target, self.depth)

    def filtered(self, *, concern: str = "all", direction: str = "both", hide_helpers: bool = False) -> Graph:
        """The part that a concern and a direction leave, without rim helpers if asked for."""
        inside = Graph(self.nodes, self.edges)
        kept = self.nodes.join(filters.concern_nodes(inside, self.target, concern), "id", "left_semi")
        kept = filters.direction_nodes(kept, direction)
        edges = filters.induced(self.edges, kept)
        if hide_helpers:
            kept = filters.without_helpers(kept, edges, self.target)
            edges = filters.induced(edges, kept)
        return Graph(kept, edges)


class Explorer:
    """Queries over one graph."""

    def __init__(self, graph: Graph):
        self.graph = graph

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Explorer:
        return cls(read_graph(spark, path))

    @classmethod
    def of(cls, analysis: Analysis) -> Explorer:
        return cls(as_graph(analysis.built))

    def search(self, needle: str, limit: int = 20) -> DataFrame:
        return neighbours.search(self.graph, needle, limit)

    def symbols(self, limit: int = 500) -> DataFrame:
        return neighbours.symbols(self.graph, limit)

    def node(self, target: str) -> DataFrame:
        return self.graph.target(target)

    def callers(self, target: str, limit: int = 50) -> DataFrame:
        return neighbours.callers(self.graph, target, limit)

    def callees(self, target: str, limit: int = 50) -> DataFrame:
        return neighbours.callees(self.graph, target, limit)

    def lineage(self, target: str, depth: int = UNLIMITED) -> Lineage:
        self.graph.target(target)
        return Lineage(self.graph, target, depth)

    def traces(self, target: str, depth: int = UNLIMITED) -> DataFrame:
        return traces.traces(self.graph, target, depth)

    def impact(self, target: str, depth: int = 3) -> dict[str, DataFrame]:
        self.graph.target(target)
        return {"nodes": traces.impact_nodes(self.graph, target), "edges": traces.impact_edges(self.graph, target), "paths": traces.impact_paths(self.graph, target, depth)}

    def surface_impact(self, target: str, depth: int = UNLIMITED) -> dict[str, DataFrame]:
        found = self.lineage(target, depth)
        parts = {"endpoints": surfaces.surface_endpoints, "tables": surfaces.surface_tables, "publishes": surfaces.surface_publishes, "consumes": surfaces.surface_consumes}
        return {name: f(self.graph, found.nodes, found.edges) for name, f in parts.items()}

    def sequence(self, target: str) -> DataFrame:
        """Messages of the target's lineage in source order."""
        found = self.lineage(target)
        return sequence.sequence(Graph(found.nodes, found.edges), target)

    def provenance(self) -> DataFrame:
        return neighbours.provenance_report(self.graph)

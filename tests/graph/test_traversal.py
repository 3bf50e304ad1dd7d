"""Traversals against a depth-first walk written from the definition."""

import random

import pytest

from tessella.operators.ranking import best_path, rank_paths
from tessella.operators.sequence import participants, sequence
from tessella.operators.traces import traces
from tessella.operators.traversal import hops, lineage_edges, lineage_paths, lineage_stats, reachable
from tessella.plans.graph import Graph

NODE, EDGE = "id string, label string, kind string, file string, line int", "src string, dst string, relation string, certainty string, line int, call_order int"


def graph_of(spark, seed, n=7, m=13):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    edges = {(rng.choice(names), rng.choice([*names, "ghost"]), rng.choice(["CALLS", "READS"])) for _ in range(m)}
    nodes = [(x, f".{x}()", "method", rng.choice([None, "src/routes/a.ts", "src/services/b.ts"]), 1) for x in names]
    return names, sorted(edges), Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, "DEFINITE", 1, None) for e in sorted(edges)], EDGE))


def walk(names, edges, target, depth):
    hop, taken, paths = {target: 0}, set(), []

    def go(direction, cur, stack, d):
        if depth and d > depth:
            return
        on = False
        for e in edges:
            near, far = (e[1], e[0]) if direction == "upstream" else (e[0], e[1])
            if near != cur or far not in names or far in stack:
                continue
            on = True
            taken.add(e)
            h = -(d + 1) if direction == "upstream" else d + 1
            if far not in hop or abs(h) < abs(hop[far]):
                hop[far] = h
            go(direction, far, [*stack, far], d + 1)
        if not on and len(stack) > 1:
            paths.append((direction, stack))

    go("upstream", target, [target], 0)
    go("downstream", target, [target], 0)
    return hop, taken, paths


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("depth", [0, 1, 2])
def test_lineage(spark, seed, depth):
    names, edges, graph = graph_of(spark, seed)
    hop, taken, paths = walk(names, edges, "n0", depth)
    assert {r.id: r.hop for r in hops(graph, "n0", depth).collect()} == hop
    assert {tuple(r) for r in lineage_edges(graph, "n0", depth).collect()} == taken
    got = sorted(lineage_paths(graph, "n0", depth).collect(), key=lambda r: (r.direction == "downstream", r.ord))
    assert [(r.direction, r.path) for r in got] == paths


def test_ranking_and_stats(spark):
    names, edges, graph = graph_of(spark, 11)
    hop, taken, paths = walk(names, edges, "n0", 0)
    files = {r.id: r.file for r in graph.nodes.collect()}
    score = lambda p: sum(1 + {"src/routes/a.ts": 5, "src/services/b.ts": 2}.get(files[x], 0) for x in p)
    found = lineage_paths(graph, "n0")
    assert [(r.direction, r.path, r.score) for r in rank_paths(graph, found).collect()] == [(*p, score(p[1])) for p in sorted(paths, key=lambda p: (-score(p[1]), -len(p[1])))]
    stats = lineage_stats(graph, "n0").first()
    assert (stats.node_count, stats.edge_count, stats.max_hop) == (len(hop), len(taken), max(map(abs, hop.values())))
    assert {r.direction for r in best_path(graph, found).collect()} == {d for d, _ in paths}


def test_bounded_traces(spark):
    names, edges, graph = graph_of(spark, 3)
    _, _, paths = walk(names, edges, "n0", 3)
    files = {r.id: r.file for r in graph.nodes.collect()}
    label = lambda x: x + (f" ({files[x].split('/')[-1]})" if files[x] else "")
    for direction in ("upstream", "downstream"):
        own = [[label(x) for x in p] for d, p in paths if d == direction][:40]
        inside = lambda a, b: len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b)))
        kept = [p for p in own if not any(inside(p, q) for q in own)]
        got = traces(graph, "n0", 3).where(f"direction = '{direction}'").collect()
        assert sorted(r.labels for r in got) == sorted(p[::-1] if direction == "upstream" else p for p in kept)
        assert sorted(r.rank for r in got if r["rank"]) == list(range(1, min(12, len(kept)) + 1))


def test_missing_target(spark):
    with pytest.raises(KeyError):
        reachable(graph_of(spark, 0)[2], "nobody").count()


def test_sequence(spark):
    nodes = [(x, x, "method", None, 1) for x in "abcxy"]
    edges = [("a", "b", "CALLS", "DEFINITE", 5, 2), ("a", "c", "CALLS", "POSSIBLE", 1, 1), ("b", "a", "CALLS", "DEFINITE", 3, 1), ("b", "x", "PUBLISHES", "DEFINITE", 9, None), ("x", "y", "CONSUMED_BY", "DEFINITE", 1, None), ("y", "c", "CALLS", "DEFINITE", 1, 1)]
    graph = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    got = sequence(graph, "a")
    rows = [(r.segment, r.number, ".".join(map(str, r.step)), r.src, r.dst, r.certain) for r in sorted(got.collect(), key=lambda r: (r.segment, r.number))]
    assert rows == [
        (0, 1, "1", "a", "c", False), (0, 2, "2", "a", "b", True), (0, 3, "2.1", "b", "a", True), (0, 4, "2.1.1", "a", "c", False), (0, 5, "2.1.2", "a", "b", True), (0, 6, "2.2", "b", "x", True),
        (1, 1, "1", "x", "y", True), (1, 2, "1.1", "y", "c", True),
    ]
    assert [r.id for r in participants(graph, got, "a").orderBy("place").collect()] == ["a", "c", "b", "x", "y"]

"""From a source tree on disk to a graph document and back, and the facade's queries on it."""

import json

import pytest

from tessella.engine import Explorer, analyze, graph_path, source_root
from tessella.sources.graph_json import write_graph, write_parts

SOURCES = {
    "app.ts": "import Fastify from 'fastify';\nimport { Handlers } from './handlers';\nconst app = Fastify();\nconst handlers = new Handlers();\napp.get('/things', handlers.list);\n",
    "handlers.ts": "import { Pool } from 'pg';\nconst pool = new Pool();\nexport class Handlers { list() { this.load(); this.note(); this.load(); } load() { return pool.query('INSERT INTO things VALUES (1)'); } note() {} }\n",
    "broken.ts": "let = = 1",
    "types.d.ts": "export type A = 1",
    "x.test.ts": "nothing()",
    "node_modules/lib/index.js": "nope()",
    "sp ace+.js": "function f() {}",
}


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return analyze(spark, str(root))


def test_scan_and_summary(analysis):
    assert sorted(r.file for r in analysis.parsed.collect()) == ["src/app.ts", "src/broken.ts", "src/handlers.ts", "src/sp ace+.js"]
    assert [r.file for r in analysis.skipped.collect()] == ["src/broken.ts"]
    counts = {r.kind: r.n for r in analysis.summary.where("kind IS NOT NULL").collect()}
    assert counts["CLASS"] == 1 and counts["METHOD"] == 3 and counts["IMPORT"] == 3


def test_statistics(analysis):
    found = analysis.statistics
    assert (found["endpoints"], found["tables"], found["topics"], found["unresolved"]) == (1, 1, 0, 0)
    assert 0 < found["parse_ms"] < found["total_ms"] and found["build_ms"] > 0


def test_source_root(tmp_path, monkeypatch):
    (tmp_path / "shop").mkdir()
    known = {"generated/shop": "shop", "generated/none": "none"}
    root = str(tmp_path)
    assert source_root(root, "/x/Generated/Shop/graph.json", known) == str(tmp_path / "shop")
    assert source_root(root, "/x/generated/none/graph.json", known) == source_root(root, "graph.json") == root
    monkeypatch.setenv("TESSELLA_SOURCE_ROOT", str(tmp_path / "shop"))
    assert source_root(root, "graph.json") == str(tmp_path / "shop")
    monkeypatch.setenv("TESSELLA_SOURCE_ROOT", str(tmp_path / "gone"))
    with pytest.raises(FileNotFoundError):
        source_root(root, "graph.json")


def test_document_round_trip_and_queries(spark, analysis, tmp_path):
    path = str(tmp_path / "graph.json")
    write_graph(analysis.built, path)
    document = json.load(open(path))
    assert {n["id"] for n in document["nodes"]} >= {"http:GET:/things", "table:things", "method:src/handlers.ts#Handlers.list"}
    write_parts(analysis.built, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "parts" / "edges")).count() == len(document["edges"])
    assert graph_path(str(tmp_path)) == path
    explorer = Explorer.load(spark, path)
    target = "method:src/handlers.ts#Handlers.load"
    lineage = explorer.lineage(target)
    assert {(r.id, r.hop) for r in lineage.nodes.collect()} >= {(target, 0), ("table:things", 1), ("http:GET:/things", -2)}
    surface = explorer.surface_impact(target)
    assert [(r.method, r.path, r.handler) for r in surface["endpoints"].collect()] == [("GET", "/things", "Handlers.list (handlers.ts)")]
    assert [(r.name, r.via) for r in surface["tables"].collect()] == [("things", ["Handlers.load (handlers.ts)"])]
    steps = explorer.sequence("http:GET:/things").orderBy("segment", "number").collect()
    assert [(".".join(map(str, r.step)), r.dst.split(".")[-1]) for r in steps] == [("1", "list"), ("1.1", "load"), ("1.1.1", "table:things"), ("1.2", "note"), ("1.3", "load"), ("1.3.1", "table:things")]
    assert {r.id for r in lineage.filtered(direction="downstream").nodes.collect()} == {target, "table:things"}
    assert explorer.search("HANDLERS.L").count() == 2 and explorer.callers(target).count() == 1
    assert [r.labels for r in explorer.traces(target).where("direction = 'downstream'").collect()] == [["Handlers.load (handlers.ts)", "things"]]
    assert {r.id for r in explorer.impact(target)["nodes"].collect()} == {"table:things", "method:src/handlers.ts#Handlers.list"}


def test_bad_document(spark, tmp_path):
    (tmp_path / "graph.json").write_text('{"nodes": []}')
    with pytest.raises(ValueError):
        Explorer.load(spark, str(tmp_path / "graph.json"))
    with pytest.raises(FileNotFoundError):
        graph_path(str(tmp_path / "nowhere"))

"""Elements and other forms that a source may hold."""

import pytest

from tessella.plans.resolution import resolve
from tessella.plans.rules import build
from tessella.sources.facts import Extractor, parse_files
from tessella.sources.syntax import SyntaxProblem

VIEW = """
import { load, save } from './api';
export function List({ name }) {
  if (!name) return <p>Don't wait, it isn't {name} & co</p>;
  return (
    <>
      <Menu.Item title="He's here" {...rest} onClick={() => load('x')} disabled />
      {items.map((i) => <li key={i}>{i > 2 ? <b>{save(i)}</b> : 'small'}</li>)}
      {/* nothing */}
    </>
  );
}
"""


def facts(file, text):
    found = Extractor(file, text)
    found.run()
    return found.facts


@pytest.mark.parametrize("text", [
    "import data from './a.json' with { type: 'json' };", "import fs = require('fs');", "if (a) /re/.test(b);", "const v = <T>w;",
    "const f = <T>(x: T) => x;", "while (a(b)) /x/g.exec(c);", "const q = (a) / b / c;", "for (const x of y) `${x}`;",
])
def test_forms_that_are_read(text):
    assert facts("src/a.ts", text)


def test_import_by_require_binds_nothing():
    first = facts("src/a.ts", "import fs = require('fs');")[0]
    assert (first["kind"], first["source"], first["bindings"]) == ("IMPORT", "", [])


def test_facts_of_elements():
    found = facts("src/view.tsx", VIEW)
    assert [f["kind"] for f in found].count("CALL") == 3 and [f["kind"] for f in found].count("RETURN") == 2
    assert sorted(f["value"] for f in found if f["kind"] == "STRING") == ["./api", "He's here", "small", "x"]
    assert facts("src/view.jsx", VIEW) and facts("src/g.tsx", "const g = <T,>(x: T) => x; const h = a < b;")


@pytest.mark.parametrize(("file", "text"), [("src/a.ts", "const a = <b>x</b>;"), ("src/a.tsx", "const a = <b>x</i>;"), ("src/a.tsx", "const a = <b c=>x</b>;"), ("src/a.tsx", "const a = <b>{x</b>;"), ("src/a.tsx", "const v = <T>w;")])
def test_broken_elements_skip_the_file(file, text):
    with pytest.raises(SyntaxProblem):
        facts(file, text)


def test_graph_of_a_view(spark):
    files = spark.createDataFrame([("src/view.tsx", VIEW), ("src/api.ts", "export function load(x) {}\nexport function save(x) {}")], "file string, content string")
    built = build(resolve(parse_files(files)))
    edges = {(r.src, r.type, r.dst) for r in built.edges.collect()}
    view = "function:src/view.tsx#List"
    assert {(view, "CALLS", "function:src/api.ts#load"), (view, "CALLS", "function:src/api.ts#save"), ("module:src/view.tsx", "IMPORTS", "module:src/api.ts")} <= edges
    assert [u.expression for u in built.unresolved.collect()] == ["items.map"]


def test_a_return_has_the_nearest_condition_around_it():
    """Of an if, both branches have its condition, and so have functions inside; a return behind it has none."""
    text = """function pick(o) {
  if (o.kind === 'one') { return a(); }
  else { return b(); }
  if (o.far) { if (o.near == 'x') return c(); else return d(); }
  if (o.list) { return items.map(function (i) { return e(); }); }
  return f();
}
"""
    said = lambda expr: expr and text[slice(*map(int, expr.split(":")[:2]))]
    got = [(said(f["expr"]), said(f.get("condition"))) for f in facts("a.ts", text) if f["kind"] == "RETURN"]
    one, near, inner = "o.kind === 'one'", "o.near == 'x'", "items.map(function (i) { return e(); })"
    assert got == [("a()", one), ("b()", one), ("c()", near), ("d()", near), (inner, "o.list"), ("e()", "o.list"), ("f()", None)]

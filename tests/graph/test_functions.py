"""Scalar functions, the parser's corners, import paths and re-exports."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.plans.resolution import resolve
from tessella.sources.facts import parse_files
from tessella.sources.syntax import SyntaxProblem, parse
from tessella.sources.tree import admitted, grammar


def values(spark, column, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_labels(spark):
    x = F.col("x")
    assert values(spark, L.plain_label(x), [".a()", "a", "()", "..b", None]) == ["a", "a", "", ".b", None]
    assert values(spark, L.basename(x), ["a/b.ts", "a\\c", "d", "e/"]) == ["b.ts", "c", "d", ""]
    assert values(spark, L.normalize_path(x), ["a/../b", "./a//b/.", "../../x", "/../y", "", "a\\b\\..\\c"]) == ["b", "a/b", "../../x", "/y", ".", "a/c"]
    assert values(spark, L.join_route(F.lit("/api/"), x), ["/a", "a", ""]) == ["/api/a", "/api/a", "/api/"]
    assert values(spark, L.join_route(F.lit(""), x), ["/a", "", "/"]) == ["/a", "/", "/"]
    assert values(spark, L.table_token(x), ["INSERT INTO orders VALUES", " insert\n into  a.b", 'INSERT INTO "q"', "SELECT 1", "INSERT x"]) == ["orders", "a", None, None, None]
    assert values(spark, L.line_of(x), ["L12", "12", "L", "Lx", None]) == [12, None, None, None, None]
    assert values(spark, L.endpoint(x)["method"], ["get /x", "FETCH /x", "GET x", " POST  /y ", ""]) == ["GET", None, None, "POST", None]
    assert [L.parse_depth(d) for d in (None, "0", "unlimited", "2.9", "-1", "x", "7")] == [0, 0, 0, 2, 0, 0, 7]


def test_admission(spark):
    files = ["a.ts", "b.d.ts", "c.min.js", "d.test.ts", "e.spec.tsx", "x/node_modules/f.ts", "g.mjs", "h.jsx", "dist/i.js", "src/dist.ts", "j.TS"]
    assert [f for f, ok in zip(files, values(spark, admitted(F.col("x")), files), strict=True) if ok] == ["a.ts", "h.jsx", "src/dist.ts"]
    assert values(spark, grammar(F.col("x")), ["a.tsx", "b.jsx", "c.ts", "d.js"]) == ["tsx", "tsx", "typescript", "javascript"]


@pytest.mark.parametrize("text", [
    "const f = async <T,>(x: T): Promise<T> => x; f<number>(1); a < b; c > d; x >>= 2; y >= 1; z = a >> 2; p > (q);",
    "for (let i = 0, n = a.length; i < n; i++) {} for (const [k, v] of m) {} for (;;) { break }  for (const k in o) {}",
    "class A<T> extends B<T> implements C, D<E> { static #x = 1; get y(): number { return 1 } @dec() z!: string; constructor(private readonly q?: X) { super() } async *g() {} }",
    "type U = { [K in keyof T]?: T[K] extends (infer R)[] ? R : never } | 'a' | `b${string}`; interface I { (x: number): void; new (y: string): I; readonly m?: () => void; get(k: string): void }",
    "const r = /[/\\]]+/g.test(s) ? a / b / c : `x${`y${1}`}`; label: while (x) continue label;",
    "export default async function () {} export * as ns from 'x'; export type { T } from './t'; import type { Q } from './q'; import y, * as z from \"z\";",
    "enum E { A = 1, B } declare module 'x' { export const a: number } abstract class Z { abstract m(): void; n() {} } namespace N.M { const q = 1 }",
    "switch (x) { case 1: case 2: f(); break; default: g() } try { a() } catch { b() } finally { c() } if (a) b(); else if (c) d()",
    "let v = x as unknown as Y<Z>[]; let w = o!.p?.[q]?.(r); const { a, b: { c }, ...rest } = o satisfies P; new Foo; new a.b.C<D>(e); x ??= y ?? z; const s = async x => await x",
])
def test_parses(text):
    assert parse(text).type == "program"


@pytest.mark.parametrize("text", ["let = = 1", "f(", "const x = <div>a</div>", "class { }}", "`open", "a b"])
def test_refuses(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_import_paths_and_reexports(spark):
    sources = {
        "src/a/main.ts": "import { One } from '../b/lib.js'; import { Two } from '@scope/pack/deep'; import Three from '../b'; import { Four } from 'outside'; import * as all from '../b/lib'; const x = new One(); const y = new Two(); const z = new Four();",
        "src/b/lib.ts": "export class One {}",
        "src/b/index.ts": "export * from './lib'; export * from '../c/more'; export * from '../b';",
        "src/c/more.ts": "export class Three {} export class One {}",
        "src/packages/pack/src/deep.ts": "export class Two {}",
    }
    program = resolve(parse_files(spark.createDataFrame(sorted(sources.items()), "file string, content string")))
    got = {r.local: r.module for r in program.imports.collect()}
    assert got == {"One": "src/b/lib.ts", "Two": "src/packages/pack/src/deep.ts", "Three": "src/b/index.ts", "Four": None, "all": "src/b/lib.ts"}
    meant = {r.local: r.symbol and r.symbol.id for r in program.imported.collect()}
    assert meant == {"One": "class:src/b/lib.ts#One", "Two": "class:src/packages/pack/src/deep.ts#Two", "Three": "class:src/c/more.ts#Three", "Four": "external:outside#Four"}

"""Registered queries from source text to graph, over a program that the relational tables write.

Every nation is a source file and every region a few: the templates below with the row's keys put in. So the whole way
from text to facts, indexes, joins and edges runs over tables, and plain SQL can say from the same rows what must come
out. A program is stored once a session and set of tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.neighbours import provenance_report
from tessella.plans.graph import Graph
from tessella.plans.resolution import Program, resolve
from tessella.plans.rules import Built, build, calls, endpoints, table_accesses
from tessella.session import materialize
from tessella.sources.facts import parse_files
from tessella.sources.tree import admitted, grammar

#: Files a region: path and text. {r} is its key.
REGION_FILES = [
    ("src/ports/r{r}.ts", "export interface Store{r} { save(id: string): void; }\n"),
    ("src/hub/r{r}.ts", "export * from '../ports/r{r}.js';\n"),
    ("src/names/r{r}/index.ts", "export const TOPIC{r} = 'topic-{r}';\n"),
    ("src/broken/r{r}.ts", "export const = ;\n"),
]
#: The file of a nation. {n} and {r} are its key and its region's; {made} follows from the key's remainder by 3.
NATION_FILE = (
    "src/n/n{n}.ts",
    """import Fastify from 'fastify';
import { Pool } from 'pg';
import { Producer, Consumer } from 'kafkajs';
import { pgTable as table } from 'drizzle-orm/pg-core';
import { Store{r} as Store } from '../hub/r{r}';
import { TOPIC{r} } from '../names/r{r}';
import { gone{n} } from './gone';
const pool = new Pool();
const app = Fastify();
const prefix = '/r{r}';
export const rows{n} = table('rows_{n}', {});
export const REGISTRY{n} = Object.freeze({ MAIN: define({ name: 'main_{n}' }) });
export class Disk{n} implements Store { save(id: string) { return pool.query('INSERT INTO nation_{n} (id) VALUES ($1)', [id]); } }
export class Cloud{n} implements Store { save(id: string) {} }
export class Nation{n} {
  private consumer: Consumer;
  constructor(private readonly store: Store, private producer: Producer) {}
  keep(id: string) { this.store.save(id); }
  twice() { this.keep('a'); helper{n}(); this.keep('b'); }
  async publish() { await this.producer.send({ topic: TOPIC{r}, messages: [] }); }
  async start() { await this.consumer.subscribe({ topic: 'topic-{r}' }); await this.consumer.run({ eachMessage: this.handle }); }
  async handle(m) {}
  list(db) { return db.select({ table: REGISTRY{n}.MAIN }); }
  add(db) { return db.insert(rows{n}); }
  missing() { nowhere{n}(); }
}
export function helper{n}() {}
export const tools{n} = { run: () => helper{n}() };
export function make{n}(options: { kind: string }): Store { if (options.kind === 'disk') { return new Disk{n}(); } return new Cloud{n}(); }
export async function plugin{n}(server) { server.post('/things', helper{n}); }
app.register(plugin{n}, { prefix });
app.get('/n/{n}', helper{n});
export const one{n} = new Nation{n}({made}, null);
""",
)
MADE = ["new Disk{n}()", "make{n}({ kind: 'disk' })", "make{n}({ kind: process.env.KIND })"]
#: Paths below a root, by a key's remainder by their number.
PATHS = ["a/b{n}.ts", "a/b{n}.d.ts", "dist/b{n}.js", "a/b{n}.test.ts", "b{n}.min.js", "a/b{n}.TSX", "a/b{n}.jsx", "a/vendor{n}/b.js", "b{n}.mjs", "node_modules/b{n}/c.tsx"]

_KEPT: dict[tuple[str, str], tuple[DataFrame, Program, Built]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, content of the program."""
    put = lambda text, **keys: reduce(lambda t, k: F.replace(t, F.lit("{" + k + "}"), keys[k]), keys, text)
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    made = F.when(n % 3 == 0, MADE[0]).when(n % 3 == 1, MADE[1]).otherwise(MADE[2])
    keys = {"made": made, "n": n.cast("string"), "r": r.cast("string")}
    nations = _table(spark, sf_dir, "nation").select(*[put(F.lit(t), **keys).alias(c) for t, c in zip(NATION_FILE, ("file", "content"), strict=True)])
    regions = _table(spark, sf_dir, "region")
    key = F.col("r_regionkey").cast("string")
    return reduce(DataFrame.unionByName, [regions.select(put(F.lit(f), r=key).alias("file"), put(F.lit(t), r=key).alias("content")) for f, t in REGION_FILES], nations)


def program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Program, Built]:
    """The parsed files, what they resolve to and their graph."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        parsed = materialize(parse_files(sources(spark, sf_dir)), "parsed")
        resolved = resolve(parsed)
        built = build(resolved)
        _KEPT[key] = parsed, resolved, Built(*[materialize(df, "built") for df in (built.nodes, built.edges, built.unresolved)])
    return _KEPT[key]


def _texts(found: Program, of: DataFrame) -> DataFrame:
    """of (file, expr and more) with the expression's text."""
    return of.join(found.exprs.select("file", "expr", "text"), ["file", "expr"])


def _edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    edges = program(spark, sf_dir)[2].edges
    return (edges.where(F.col("type").isin(*kinds)) if kinds else edges).select("src", "dst", "type", "rule", "certainty", F.size("evidence").cast("long").alias("n_evidence"))


def src02_admitted(spark, sf_dir):
    paths = F.array(*[F.replace(F.lit(p), F.lit("{n}"), F.col("s_suppkey").cast("string")) for p in PATHS])
    each = _table(spark, sf_dir, "supplier").select(F.get(paths, (F.col("s_suppkey") % len(PATHS)).cast("int")).alias("path"))
    return each.select("path", admitted(F.col("path")).alias("admitted"), grammar(F.col("path")).alias("grammar"))


def src06_skipped(spark, sf_dir):
    return program(spark, sf_dir)[0].select("file", F.col("problem").isNotNull().alias("skipped"))


def fct01_kinds(spark, sf_dir):
    return program(spark, sf_dir)[1].facts.groupBy("file", "kind").agg(F.count("*").alias("n"))


def fct03_symbols(spark, sf_dir):
    facts = program(spark, sf_dir)[1].facts.where("symbol IS NOT NULL")
    return facts.select("file", F.col("symbol.id").alias("id"), F.col("symbol.kind").alias("kind"), F.col("owner.id").alias("owner"), F.coalesce("exported", F.lit(False)).alias("exported"))


def fct11_calls(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    return _texts(found, found.facts.where("kind = 'CALL'").select("file", "expr", "owner")).select("file", F.col("owner.id").alias("owner"), "text")


def fct14_returns(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    condition = found.exprs.select("file", F.col("expr").alias("condition"), F.col("text").alias("when_text"))
    rows = _texts(found, found.facts.where("kind = 'RETURN'").select("file", "expr", "owner", "condition")).join(condition, ["file", "condition"], "left")
    return rows.select("file", F.col("owner.id").alias("owner"), "text", F.coalesce("when_text", F.lit("")).alias("when_text"))


def fct15_expressions(spark, sf_dir):
    found = program(spark, sf_dir)[1].exprs
    return found.groupBy("file", "kind").agg(F.count("*").alias("n"))


def idx01_types(spark, sf_dir):
    found = program(spark, sf_dir)[1].type_names
    return found.select("file", "name", F.col("type.id").alias("id"), F.col("type.kind").alias("kind"))


def idx02_functions(spark, sf_dir):
    return program(spark, sf_dir)[1].functions.select("file", "name", F.col("symbol.id").alias("id"), F.coalesce("type", F.lit("")).alias("returns"))


def idx03_parameters(spark, sf_dir):
    rows = program(spark, sf_dir)[1].facts.where("kind = 'ARGUMENT' AND name IS NOT NULL")
    return rows.select(F.col("owner.id").alias("owner"), "name", F.coalesce("type", F.lit("")).alias("type"), F.col("index").cast("long").alias("place"))


def idx04_methods(spark, sf_dir):
    return program(spark, sf_dir)[1].methods.select("container", "name", F.col("symbol.id").alias("id"))


def idx05_values(spark, sf_dir):
    return program(spark, sf_dir)[1].values.select("scope", "name", "decl", "exported")


def idx07_properties(spark, sf_dir):
    return program(spark, sf_dir)[1].properties.select("class", "name", "type", F.coalesce(F.col("index").cast("long"), F.lit(-1)).alias("place"))


def idx08_imports(spark, sf_dir):
    return program(spark, sf_dir)[1].imports.select("file", "local", "source", "imported", F.coalesce("module", F.lit("")).alias("module"))


def jn03_imported(spark, sf_dir):
    found = program(spark, sf_dir)[1].imported
    return found.select("file", "local", F.coalesce("symbol.id", F.lit("")).alias("symbol"), F.coalesce("decl", F.lit("")).alias("decl"))


def jn05_types(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    return _texts(found, found.types).groupBy("file", "text").agg(F.min("type.id").alias("type"), F.count("*").alias("n"))


def jn07_references(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    called = found.exprs.where("kind = 'CALL'").select("file", F.col("base").alias("expr")).distinct()
    return _texts(found, found.references.join(called, ["file", "expr"])).select("file", "text", "ref", F.col("symbol.id").alias("symbol"))


def jn08_statics(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    names = found.exprs.where("kind = 'IDENTIFIER'").select("file", "expr")
    return _texts(found, found.statics.withColumnRenamed("text", "value").join(names, ["file", "expr"])).select("file", "text", "value")


def jn09_value_symbols(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    return _texts(found, found.value_symbols).groupBy("file", "text", "decl").agg(F.count("*").alias("n"))


def jn10_imports(spark, sf_dir):
    return _edges(spark, sf_dir, "IMPORTS")


def jn11_calls(spark, sf_dir):
    edges = program(spark, sf_dir)[2].edges.where("type = 'CALLS'")
    return edges.select("src", "dst", F.array_join(F.transform("occurrences", lambda o: o["order"].cast("string")), ",").alias("orders"))


def jn12_unresolved(spark, sf_dir):
    return program(spark, sf_dir)[2].unresolved.select("expression", "file", F.col("line").cast("long").alias("line"))


def jn13_endpoints(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    routes = endpoints(found, materialize(calls(found), "calls"))
    return routes.select("file", "method", "path", F.col("handler.id").alias("handler"), F.size("evidence").cast("long").alias("n_evidence"))


def jn15_tables(spark, sf_dir):
    found = program(spark, sf_dir)[1]
    return table_accesses(found, materialize(calls(found), "calls")).select("file", F.col("owner.id").alias("owner"), F.col("table").alias("table_name"), "operation")


def jn17_topics(spark, sf_dir):
    return _edges(spark, sf_dir, "PUBLISHES", "CONSUMED_BY")


def jn19_interfaces(spark, sf_dir):
    return _edges(spark, sf_dir, "IMPLEMENTS", "DEPENDS_ON")


def jn21_injected(spark, sf_dir):
    return _edges(spark, sf_dir, "INJECTED_WITH")


def jn23_dispatch(spark, sf_dir):
    return _edges(spark, sf_dir, "RESOLVES_TO", "POSSIBLE_RESOLUTION")


def bld01_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def bld02_nodes(spark, sf_dir):
    return program(spark, sf_dir)[2].nodes.select("id", "type", "name", F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col("line").cast("long"), F.lit(-1)).alias("line"))


def snk03_provenance(spark, sf_dir):
    """The report of the graph: names for ids, whether the source proves an edge, rule, confidence, certainty."""
    built = program(spark, sf_dir)[2]
    graph = Graph(built.nodes.select("id", F.col("name").alias("label")), built.edges.withColumnRenamed("type", "relation"))
    return provenance_report(graph)


SOURCE_QUERIES = {name: f for name, f in list(globals().items()) if name[:3] in ("src", "snk", "fct", "idx", "jn0", "jn1", "jn2", "bld") and callable(f) and getattr(f, "__module__", "") == __name__}

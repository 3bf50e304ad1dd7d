"""Graphs of small sources of our own: what must be there, and what must not."""

import pytest

from tessella.plans.resolution import resolve
from tessella.plans.rules import build
from tessella.sources.facts import parse_files

SHOP = {
    "src/app.ts": """
import Fastify from 'fastify';
import { Pool } from 'pg';
import { ordersPlugin } from './routes/orders.js';
import { OrderHandlers } from './handlers';
import { TOPIC_PREFIX as prefix } from './names';
const app = Fastify({ logger: true });
const handlers = new OrderHandlers();
app.register(ordersPlugin, { prefix });
app.get('/health', handlers.health);
export async function main() { await app.listen(); unknownThing(); }
""",
    "src/names.ts": "export const TOPIC_PREFIX = '/api';\nexport const TOPIC = `orders`;",
    "src/handlers/index.ts": "export * from './orders';",
    "src/handlers/orders.ts": """
import { OrderStore } from '../store';
export class OrderHandlers {
  private store = new OrderStore();
  health() { return this.ping(); }
  ping() { return this.store.save({ id: 1 }); }
  twice() { this.ping(); this.health(); this.ping(); }
}
""",
    "src/routes/orders.ts": """
import { OrderHandlers } from '../handlers';
const handlers = new OrderHandlers();
export async function ordersPlugin(server) { server.post('/orders', { schema: {} }, handlers.ping); other.post('/no', handlers.ping); }
""",
    "src/store.ts": """
import { Pool } from 'pg';
const pool = new Pool();
export class OrderStore {
  private other = { query(x) { return x; } };
  save(o) { return pool.query('INSERT INTO orders (id) VALUES ($1)', [o.id]); }
  fake(o) { return this.other.query('INSERT INTO ghosts VALUES (1)'); }
}
""",
}
PARTS = {
    "src/ports.ts": "export interface Store { save(id: string): void; }\nexport interface Unused { run(): void }",
    "src/stores.ts": """
import { Store } from './ports';
export class DiskStore implements Store { save(id: string) {} }
export class CloudStore implements Store { save(id: string) {} }
export class Stray implements Store { save(id: string) {} }
""",
    "src/service.ts": """
import { Store } from './ports';
export class Service { constructor(private readonly store: Store) {} keep(id: string) { this.store.save(id); } }
export class Other { constructor(private readonly store: Store) {} keep(id: string) { this.store.save(id); } }
export class Third { constructor(private readonly store: Store) {} keep(id: string) { this.store.save(id); } }
""",
    "src/factory.ts": """
import { Store } from './ports';
import { DiskStore, CloudStore } from './stores';
export function makeStore(options: { kind: string }): Store {
  if (options.kind === 'disk') { return new DiskStore(); }
  return new CloudStore();
}
""",
    "src/root.ts": """
import { Service, Other, Third } from './service';
import { DiskStore } from './stores';
import { makeStore } from './factory';
export const a = new Service(new DiskStore());
export const b = new Other(makeStore({ kind: 'disk' }));
export const c = new Third(makeStore({ kind: process.env.KIND }));
""",
    "src/bus.ts": """
import { Producer, Consumer } from 'kafkajs';
import { TOPIC } from './names';
class Sender { constructor(private producer: Producer) {} async go() { await this.producer.send({ topic: TOPIC, messages: [] }); } }
class Reader {
  private consumer: Consumer;
  async start() { await this.consumer.subscribe({ topic: 'orders' }); await this.consumer.run({ eachMessage: this.handle }); }
  async handle(m) {}
}
class Fake { constructor(private producer: Mailer) {} go() { this.producer.send({ topic: 'spam' }); } }
""",
    "src/names.ts": "export const TOPIC = 'orders';",
    "src/tables.ts": """
import { pgTable } from 'drizzle-orm/pg-core';
export const TABLES = Object.freeze({ USERS: define({ name: 'users' }) });
export const items = pgTable('items', {});
""",
    "src/access.ts": """
import { TABLES, items as rows } from './tables';
export class Access { list(db) { return db.select({ table: TABLES.USERS }); } add(db) { return db.insert(rows); } none(db) { return db.update('users'); } }
""",
}


def graph(spark, sources):
    files = spark.createDataFrame(sorted(sources.items()), "file string, content string")
    parsed = parse_files(files)
    assert [tuple(r) for r in parsed.select("file", "problem").where("problem IS NOT NULL").collect()] == []
    built = build(resolve(spark.createDataFrame(parsed.collect(), parsed.schema)))
    edges = {(r.src, r.type, r.dst): r for r in built.edges.collect()}
    return {r.id: r for r in built.nodes.collect()}, edges, built.unresolved.collect()


@pytest.fixture(scope="module")
def shop(spark):
    return graph(spark, SHOP)


@pytest.fixture(scope="module")
def parts(spark):
    return graph(spark, PARTS)


def test_shop(shop):
    nodes, edges, unresolved = shop
    handler = "method:src/handlers/orders.ts#OrderHandlers."
    for e in [
        ("module:src/app.ts", "IMPORTS", "module:src/routes/orders.ts"),
        ("module:src/app.ts", "IMPORTS", "module:src/handlers/index.ts"),
        ("http:GET:/health", "HANDLES", handler + "health"),
        ("http:POST:/api/orders", "HANDLES", handler + "ping"),
        (handler + "health", "CALLS", handler + "ping"),
        (handler + "ping", "CALLS", "method:src/store.ts#OrderStore.save"),
        ("method:src/store.ts#OrderStore.save", "WRITES", "table:orders"),
    ]:
        assert e in edges, e
    assert "table:ghosts" not in nodes and not any("/no" in i for i in nodes)
    assert sorted(u.expression for u in unresolved) == ["other.post", "this.other.query", "unknownThing"]
    twice = {(k[2], tuple(o["order"] for o in e.occurrences)) for k, e in edges.items() if k[:2] == (handler + "twice", "CALLS")}
    assert twice == {(handler + "ping", (1, 3)), (handler + "health", (2,))}
    assert nodes["http:POST:/api/orders"].name == "POST /api/orders" and len(edges["http:POST:/api/orders", "HANDLES", handler + "ping"].evidence) == 2
    assert {n.type for n in nodes.values()} == {"MODULE", "CLASS", "CLASS_PROPERTY", "METHOD", "FUNCTION", "HTTP_ENDPOINT", "DATABASE_TABLE"}


def test_parts(parts):
    nodes, edges, unresolved = parts
    store, disk, cloud = "interface:src/ports.ts#Store", "class:src/stores.ts#DiskStore", "class:src/stores.ts#CloudStore"
    save = lambda c: f"method:src/stores.ts#{c}.save"
    keep = lambda c: f"method:src/service.ts#{c}.keep"
    prop = lambda c: f"property:src/service.ts#{c}.store"
    for e in [
        (disk, "IMPLEMENTS", store), ("class:src/service.ts#Service", "DEPENDS_ON", store),
        (prop("Service"), "INJECTED_WITH", disk), ("method:src/ports.ts#Store.save", "RESOLVES_TO", save("DiskStore")),
        (keep("Service"), "CALLS", "method:src/ports.ts#Store.save"),
        (prop("Other"), "INJECTED_WITH", disk), (keep("Other"), "RESOLVES_TO", save("DiskStore")),
        (keep("Third"), "POSSIBLE_RESOLUTION", save("DiskStore")), (keep("Third"), "POSSIBLE_RESOLUTION", save("CloudStore")),
        ("method:src/bus.ts#Sender.go", "PUBLISHES", "topic:orders"), ("topic:orders", "CONSUMED_BY", "method:src/bus.ts#Reader.handle"),
        ("method:src/access.ts#Access.list", "READS", "table:users"), ("method:src/access.ts#Access.add", "WRITES", "table:items"),
    ]:
        assert e in edges, e
    assert not any(k[2] == save("Stray") for k in edges if k[1] != "CALLS")
    assert (prop("Third"), "INJECTED_WITH", cloud) not in edges and (keep("Other"), "RESOLVES_TO", save("CloudStore")) not in edges
    assert edges[keep("Third"), "POSSIBLE_RESOLUTION", save("CloudStore")].certainty == "POSSIBLE"
    assert "topic:spam" not in nodes and not any(k[0] == "method:src/access.ts#Access.none" for k in edges)


def test_table_names_fold_in_order_and_default_imports(spark):
    sources = {f"src/t{i}.ts": f"import {{ pgTable }} from 'drizzle-orm/pg-core'; export const {n} = pgTable('{t}', {{}});" for i, (n, t) in enumerate([("a", "one"), ("a", "two"), ("b", "one"), ("b", "two"), ("b", "three"), ("c", "x"), ("c", "x")])}
    sources["src/use.ts"] = "export class Use { go(db) { db.read(a); db.read(b); db.read(c); } }"
    sources["src/d.ts"] = "export default class Thing { run() {} }\nexport class Local { run() {} }"
    sources["src/e.ts"] = "import Local from './d'; const l = new Local(); export function f() { l.run(); }"
    nodes, edges, _ = graph(spark, sources)
    assert {k[2] for k in edges if k[1] == "READS"} == {"table:three", "table:x"}
    assert ("function:src/e.ts#f", "CALLS", "method:src/d.ts#Local.run") in edges

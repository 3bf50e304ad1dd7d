"""What the program of source_queries must give, in plain SQL over the tables that write it.

Expected rows are patterns of a row's keys: {n}, {r} and, where a row is there for some nations only, the remainder by
3 of the nation's key.
"""

from __future__ import annotations

from tessella.plans.source_queries import PATHS

_N, _R = "src/n/n{n}.ts", "src/ports/r{r}.ts"
_TYPES = {"exported": "BOOLEAN", "skipped": "BOOLEAN"} | dict.fromkeys(("n", "place", "line", "n_evidence"), "BIGINT")
_METHODS = ["Disk{n}.save", "Cloud{n}.save", *[f"Nation{{n}}.{x}" for x in ("constructor", "keep", "twice", "publish", "start", "handle", "list", "add", "missing")]]
_VALUES = [("pool", False), ("app", False), ("prefix", False), ("rows{n}", True), ("REGISTRY{n}", True), ("tools{n}", True), ("one{n}", True)]
_FUNCTIONS = ["helper{n}", "tools{n}.run", "make{n}", "plugin{n}"]
_TOPIC = "variable:src/names/r{r}/index.ts#module:src/names/r{r}/index.ts/TOPIC{r}"


def _quoted(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _rows(columns: str, nations: list[tuple], regions: list[tuple] = (), distinct: bool = False) -> str:
    """SQL of the expected rows; a row longer than the columns ends with the remainder that it needs."""
    names = columns.split()

    def part(table: str, keys: str, rows: list[tuple]) -> str:
        filled = [(*r[: len(names)], r[len(names)] if len(r) > len(names) else -1) for r in rows]
        values = ", ".join("(" + ", ".join([*map(_quoted, r[:-1]), str(r[-1])]) + ")" for r in filled)
        held = ", ".join(f"c{i}" for i in range(len(names)))
        put = lambda i: f"replace(replace(c{i}, '{{n}}', k.n), '{{r}}', k.r)"
        shown = ", ".join(f"CAST({put(i)} AS {_TYPES.get(x, 'VARCHAR')}) AS {x}" for i, x in enumerate(names))
        return f"SELECT {shown} FROM (SELECT {keys} FROM {table}) AS k, (VALUES {values}) AS t({held}, m) WHERE t.m < 0 OR t.m = k.m"

    parts = [part("nation", "CAST(n_nationkey AS VARCHAR) AS n, CAST(n_regionkey AS VARCHAR) AS r, n_nationkey % 3 AS m", nations)] if nations else []
    if regions:
        parts.append(part("region", "'' AS n, CAST(r_regionkey AS VARCHAR) AS r, 0 AS m", list(regions)))
    both = " UNION ALL ".join(parts)
    return f"SELECT DISTINCT * FROM ({both})" if distinct else both


def _id(kind: str, name: str) -> str:
    return f"{kind}:{_N}#{name}"


def _value(name: str) -> str:
    return _id("variable", f"module:{_N}/{name}")


#: Per kind of fact: how many a nation's file has, by remainder.
_KINDS = {"IMPORT": (7, 7, 7), "EXPORT": (10, 10, 10), "CLASS": (3, 3, 3), "METHOD": (11, 11, 11), "FUNCTION": (4, 4, 4), "VARIABLE": (7, 7, 7), "CLASS_PROPERTY": (3, 3, 3), "CONDITION": (1, 1, 1), "RETURN": (5, 5, 5), "TYPE_ANNOTATION": (6, 6, 6), "NEW": (5, 4, 4), "CALL": (19, 20, 20), "MEMBER": (20, 20, 22), "OBJECT": (9, 10, 10), "STRING": (17, 18, 17), "ARGUMENT": (30, 31, 31)}
_EXPRESSIONS = {"ARRAY_LITERAL": (2, 2, 2), "BINARY": (1, 1, 1), "CALL": (19, 20, 20), "IDENTIFIER": (28, 28, 29), "MEMBER": (20, 20, 22), "NEW": (5, 4, 4), "OBJECT_LITERAL": (9, 10, 10), "STRING_LITERAL": (17, 18, 17), "THIS": (7, 7, 7), "UNKNOWN": (5, 5, 5)}
_by_rest = lambda kinds: [(_N, k, n, m) for k, ns in kinds.items() for m, n in enumerate(ns)]

_CALLS = [
    (f"module:{_N}", "Fastify()"), (f"module:{_N}", "table('rows_{n}', {})"), (f"module:{_N}", "Object.freeze({ MAIN: define({ name: 'main_{n}' }) })"),
    (f"module:{_N}", "define({ name: 'main_{n}' })"), (f"module:{_N}", "app.register(plugin{n}, { prefix })"), (f"module:{_N}", "app.get('/n/{n}', helper{n})"),
    (f"module:{_N}", "make{n}({ kind: 'disk' })", 1), (f"module:{_N}", "make{n}({ kind: process.env.KIND })", 2),
    (_id("method", "Disk{n}.save"), "pool.query('INSERT INTO nation_{n} (id) VALUES ($1)', [id])"), (_id("method", "Nation{n}.keep"), "this.store.save(id)"),
    (_id("method", "Nation{n}.twice"), "this.keep('a')"), (_id("method", "Nation{n}.twice"), "helper{n}()"), (_id("method", "Nation{n}.twice"), "this.keep('b')"),
    (_id("method", "Nation{n}.publish"), "this.producer.send({ topic: TOPIC{r}, messages: [] })"), (_id("method", "Nation{n}.start"), "this.consumer.subscribe({ topic: 'topic-{r}' })"),
    (_id("method", "Nation{n}.start"), "this.consumer.run({ eachMessage: this.handle })"), (_id("method", "Nation{n}.list"), "db.select({ table: REGISTRY{n}.MAIN })"),
    (_id("method", "Nation{n}.add"), "db.insert(rows{n})"), (_id("method", "Nation{n}.missing"), "nowhere{n}()"),
    (_id("function", "tools{n}.run"), "helper{n}()"), (_id("function", "plugin{n}"), "server.post('/things', helper{n})"),
]
_RETURNS = [
    (_id("method", "Disk{n}.save"), "pool.query('INSERT INTO nation_{n} (id) VALUES ($1)', [id])", ""), (_id("method", "Nation{n}.list"), "db.select({ table: REGISTRY{n}.MAIN })", ""),
    (_id("method", "Nation{n}.add"), "db.insert(rows{n})", ""), (_id("function", "make{n}"), "new Disk{n}()", "options.kind === 'disk'"), (_id("function", "make{n}"), "new Cloud{n}()", ""),
]
_IMPORTS = [("Fastify", "fastify", "default", ""), ("Pool", "pg", "Pool", ""), ("Producer", "kafkajs", "Producer", ""), ("Consumer", "kafkajs", "Consumer", ""), ("table", "drizzle-orm/pg-core", "pgTable", ""), ("Store", "../hub/r{r}", "Store{r}", "src/hub/r{r}.ts"), ("TOPIC{r}", "../names/r{r}", "TOPIC{r}", "src/names/r{r}/index.ts"), ("gone{n}", "./gone", "gone{n}", "")]
_STORE = f"interface:{_R}#Store{{r}}"
_EXTERNAL = [("Fastify", "external:fastify#Fastify"), ("Pool", "external:pg#Pool"), ("Producer", "external:kafkajs#Producer"), ("Consumer", "external:kafkajs#Consumer"), ("table", "external:drizzle-orm/pg-core#pgTable"), ("gone{n}", "external:./gone#gone{n}")]
_CLASSES = ["Disk{n}", "Cloud{n}", "Nation{n}"]
_FASTIFY, _POOL, _PRODUCER, _CONSUMER, _TABLE = ("external:" + x for x in ("fastify#Fastify", "pg#Pool", "kafkajs#Producer", "kafkajs#Consumer", "drizzle-orm/pg-core#pgTable"))
_CLASS = lambda name: _id("class", name)
_TYPED = [
    ("Fastify", _FASTIFY, 1), ("Fastify()", _FASTIFY, 1), ("app", _FASTIFY, 2), ("app.get('/n/{n}', helper{n})", _FASTIFY + ".get", 1), ("app.register(plugin{n}, { prefix })", _FASTIFY + ".register", 1),
    ("Pool", _POOL, 1), ("new Pool()", _POOL, 1), ("pool", _POOL, 1), ("pool.query('INSERT INTO nation_{n} (id) VALUES ($1)', [id])", _POOL + ".query", 1),
    ("table", _TABLE, 1), ("table('rows_{n}', {})", _TABLE, 1), ("rows{n}", _TABLE, 1), ("this", _CLASS("Nation{n}"), 7), ("this.store", _STORE, 1),
    ("this.producer", _PRODUCER, 1), ("this.producer.send({ topic: TOPIC{r}, messages: [] })", _PRODUCER + ".send", 1), ("this.consumer", _CONSUMER, 2),
    ("this.consumer.subscribe({ topic: 'topic-{r}' })", _CONSUMER + ".subscribe", 1), ("this.consumer.run({ eachMessage: this.handle })", _CONSUMER + ".run", 1),
    ("Cloud{n}", _CLASS("Cloud{n}"), 1), ("new Cloud{n}()", _CLASS("Cloud{n}"), 1), ("Nation{n}", _CLASS("Nation{n}"), 1),
    *[(t, _CLASS("Disk{n}"), 2 - bool(m), m) for t in ("Disk{n}", "new Disk{n}()") for m in range(3)],
    *[(f"new Nation{{n}}({made}, null)", _CLASS("Nation{n}"), 1, m) for m, made in enumerate(("new Disk{n}()", "make{n}({ kind: 'disk' })", "make{n}({ kind: process.env.KIND })"))],
]
_HELPER, _KEEP = _id("function", "helper{n}"), _id("method", "Nation{n}.keep")
_SAVE = f"method:{_R}#Store{{r}}.save"
_REFERENCES = [
    ("Fastify", "EXTERNAL", _FASTIFY), ("app.get", "EXTERNAL", _FASTIFY + ".get"), ("app.register", "EXTERNAL", _FASTIFY + ".register"), ("table", "EXTERNAL", _TABLE),
    ("pool.query", "EXTERNAL", _POOL + ".query"), ("this.producer.send", "EXTERNAL", _PRODUCER + ".send"), ("this.consumer.subscribe", "EXTERNAL", _CONSUMER + ".subscribe"), ("this.consumer.run", "EXTERNAL", _CONSUMER + ".run"),
    ("helper{n}", "FUNCTION", _HELPER), ("helper{n}", "FUNCTION", _HELPER), ("this.keep", "METHOD", _KEEP), ("this.keep", "METHOD", _KEEP), ("this.store.save", "METHOD", _SAVE),
    *[("make{n}", "FUNCTION", _id("function", "make{n}"), m) for m in (1, 2)],
]

# Edges: src, dst, type, rule, certainty, places of evidence.
_IMPORT_EDGES = [(f"module:{_N}", f"module:src/{to}.ts", "IMPORTS", "syntax", "DEFINITE", 1) for to in ("hub/r{r}", "names/r{r}/index")]
_CALL_ORDERS = [(_KEEP, _SAVE, "1"), (_id("method", "Nation{n}.twice"), _KEEP, "1,3"), (_id("method", "Nation{n}.twice"), _HELPER, "2"), (_id("function", "tools{n}.run"), _HELPER, "1")]
_CALL_EDGES = [(a, b, "CALLS", "symbol-resolution", "DEFINITE", len(o.split(","))) for a, b, o in _CALL_ORDERS]
_ROUTES = [(f"http:{verb}:{path}", _HELPER, "HANDLES", "fastify-route", "DEFINITE", n) for verb, path, n in (("GET", "/n/{n}", 1), ("POST", "/r{r}/things", 2))]
_ACCESSES = [(_id("method", "Disk{n}.save"), "nation_{n}", "INSERT"), (_id("method", "Nation{n}.add"), "rows_{n}", "INSERT"), (_id("method", "Nation{n}.list"), "main_{n}", "SELECT")]
_TABLE_EDGES = [(a, f"table:{t}", "READS" if o == "SELECT" else "WRITES", "sql-table-access", "DEFINITE", 1) for a, t, o in _ACCESSES]
_TOPICS = [(_id("method", "Nation{n}.publish"), "topic:topic-{r}", "PUBLISHES", "kafka-event", "DEFINITE", 1), ("topic:topic-{r}", _id("method", "Nation{n}.handle"), "CONSUMED_BY", "kafka-event", "DEFINITE", 2)]
_INTERFACES = [(_CLASS(c), _STORE, "IMPLEMENTS", "interface-di", "DEFINITE", 1) for c in _CLASSES[:2]] + [(_CLASS("Nation{n}"), _STORE, "DEPENDS_ON", "interface-di", "DEFINITE", 1)]
_INJECTED = [(_id("property", "Nation{n}.store"), _CLASS("Disk{n}"), "INJECTED_WITH", rule, "DEFINITE", n, m) for rule, n, m in (("interface-di", 1, 0), ("conditional-factory-analysis", 2, 1))]
_DISPATCH = [
    (_SAVE, _id("method", "Disk{n}.save"), "RESOLVES_TO", "interface-di", "DEFINITE", 2, 0),
    (_KEEP, _id("method", "Disk{n}.save"), "RESOLVES_TO", "conditional-factory-analysis", "DEFINITE", 3, 1),
    *[(_KEEP, _id("method", f"{c}.save"), "POSSIBLE_RESOLUTION", "conditional-factory-analysis", "POSSIBLE", 3, 2) for c in _CLASSES[:2]],
]
_EDGES = "src dst type rule certainty n_evidence"
_ALL_EDGES = [*_IMPORT_EDGES, *_CALL_EDGES, *_ROUTES, *_TABLE_EDGES, *_TOPICS, *_INTERFACES, *_INJECTED, *_DISPATCH]

_LINES = {"Disk{n}": 13, "Disk{n}.save": 13, "Cloud{n}": 14, "Cloud{n}.save": 14, "Nation{n}": 15, "helper{n}": 27, "tools{n}.run": 28, "make{n}": 29, "plugin{n}": 30} | {f"Nation{{n}}.{x}": 17 + i for i, x in enumerate(("constructor", "keep", "twice", "publish", "start", "handle", "list", "add", "missing"))}
_PROPERTIES = [("consumer", "Consumer", -1, 16), ("store", "Store", 0, 17), ("producer", "Producer", 1, 17)]
_NODES = [
    (f"module:{_N}", "MODULE", _N, _N, 1),
    *[(_CLASS(c), "CLASS", c, _N, _LINES[c]) for c in _CLASSES],
    *[(_id("method", x), "METHOD", x, _N, _LINES[x]) for x in _METHODS],
    *[(_id("function", x), "FUNCTION", x, _N, _LINES[x]) for x in _FUNCTIONS],
    *[(_id("property", f"Nation{{n}}.{x}"), "CLASS_PROPERTY", f"Nation{{n}}.{x}", _N, line) for x, _, _, line in _PROPERTIES],
    *[(f"table:{t}", "DATABASE_TABLE", t, "", -1) for _, t, _ in _ACCESSES],
    ("topic:topic-{r}", "EVENT_TOPIC", "topic-{r}", "", -1),
    ("http:GET:/n/{n}", "HTTP_ENDPOINT", "GET /n/{n}", _N, 32),
]
_REGION_NODES = [*[(f"module:{f}", "MODULE", f, f, 1) for f in (_R, "src/hub/r{r}.ts", "src/names/r{r}/index.ts")], (_STORE, "INTERFACE", "Store{r}", _R, 1), (_SAVE, "METHOD", "Store{r}.save", _R, 1)]
#: The route that nations of a region share stands where the first of their files has it.
_SHARED_ROUTE = "SELECT 'http:POST:/r' || n_regionkey || '/things' AS id, 'HTTP_ENDPOINT' AS type, 'POST /r' || n_regionkey || '/things' AS name, min('src/n/n' || n_nationkey || '.ts') AS file, CAST(30 AS BIGINT) AS line FROM nation GROUP BY n_regionkey"
_BUILT_NODES = f"{_rows('id type name file line', _NODES, _REGION_NODES, distinct=True)} UNION ALL {_SHARED_ROUTE}"
_ADMITTED = ", ".join(f"({i}, {_quoted(p)}, {str(i in (0, 6, 7)).lower()}, '{'tsx' if i in (5, 6, 9) else 'typescript' if i in (0, 1, 3) else 'javascript'}')" for i, p in enumerate(PATHS))

SOURCE_SQL = {
    "src02_admitted": f"SELECT replace(p, '{{n}}', CAST(s_suppkey AS VARCHAR)) AS path, a AS admitted, g AS grammar FROM supplier JOIN (VALUES {_ADMITTED}) AS t(i, p, a, g) ON s_suppkey % {len(PATHS)} = i",
    "src06_skipped": _rows("file skipped", [(_N, False)], [(_R, False), ("src/hub/r{r}.ts", False), ("src/names/r{r}/index.ts", False), ("src/broken/r{r}.ts", True)]),
    "fct01_kinds": _rows("file kind n", _by_rest(_KINDS), [(_R, k, 1) for k in ("ARGUMENT", "EXPORT", "INTERFACE", "METHOD", "TYPE_ANNOTATION")] + [("src/hub/r{r}.ts", k, 1) for k in ("EXPORT", "STRING")] + [("src/names/r{r}/index.ts", k, 1) for k in ("EXPORT", "STRING", "VARIABLE")]),
    "fct03_symbols": _rows("file id kind owner exported", [
        *[(_N, _CLASS(c), "CLASS", f"module:{_N}", True) for c in _CLASSES],
        *[(_N, _id("method", x), "METHOD", _CLASS(x.split(".")[0]), False) for x in _METHODS],
        *[(_N, _id("function", x), "FUNCTION", f"module:{_N}", True) for x in _FUNCTIONS],
        *[(_N, _id("property", f"Nation{{n}}.{x[0]}"), "CLASS_PROPERTY", _CLASS("Nation{n}"), False) for x in _PROPERTIES],
        *[(_N, _value(x), "VARIABLE", f"module:{_N}", out) for x, out in _VALUES],
    ], [(_R, _STORE, "INTERFACE", f"module:{_R}", True), (_R, _SAVE, "METHOD", _STORE, False), ("src/names/r{r}/index.ts", _TOPIC, "VARIABLE", "module:src/names/r{r}/index.ts", True)]),
    "fct11_calls": _rows("file owner text", [(_N, *x) for x in _CALLS]),
    "fct14_returns": _rows("file owner text when_text", [(_N, *x) for x in _RETURNS]),
    "fct15_expressions": _rows("file kind n", _by_rest(_EXPRESSIONS), [("src/hub/r{r}.ts", "STRING_LITERAL", 1), ("src/names/r{r}/index.ts", "STRING_LITERAL", 1)]),
    "idx01_types": _rows("file name id kind", [*[(_N, c, _CLASS(c), "CLASS") for c in _CLASSES], *[(_N, x, s, "EXTERNAL") for x, s in _EXTERNAL], (_N, "Store", _STORE, "INTERFACE")], [(_R, "Store{r}", _STORE, "INTERFACE")]),
    "idx02_functions": _rows("file name id returns", [(_N, x, _id("function", x), "Store" if x == "make{n}" else "") for x in _FUNCTIONS]),
    "idx03_parameters": _rows("owner name type place", [(_id(kind, f), x, t, i) for kind, f, x, t, i in (("method", "Disk{n}.save", "id", "string", 0), ("method", "Cloud{n}.save", "id", "string", 0), ("method", "Nation{n}.constructor", "store", "Store", 0), ("method", "Nation{n}.constructor", "producer", "Producer", 1), ("method", "Nation{n}.keep", "id", "string", 0), ("method", "Nation{n}.handle", "m", "", 0), ("method", "Nation{n}.list", "db", "", 0), ("method", "Nation{n}.add", "db", "", 0), ("function", "make{n}", "options", "{ kind: string }", 0), ("function", "plugin{n}", "server", "", 0))], [(_SAVE, "id", "string", 0)]),
    "idx04_methods": _rows("container name id", [(_CLASS(x.split(".")[0]), x.split(".")[1], _id("method", x)) for x in _METHODS], [(_STORE, "save", _SAVE)]),
    "idx05_values": _rows("scope name decl exported", [(f"module:{_N}", x, _value(x), out) for x, out in _VALUES], [("module:src/names/r{r}/index.ts", "TOPIC{r}", _TOPIC, True)]),
    "idx07_properties": _rows("class name type place", [(_CLASS("Nation{n}"), x, t, i) for x, t, i, _ in _PROPERTIES]),
    "idx08_imports": _rows("file local source imported module", [(_N, *x) for x in _IMPORTS]),
    "jn03_imported": _rows("file local symbol decl", [*[(_N, x, s, "") for x, s in _EXTERNAL], (_N, "Store", _STORE, ""), (_N, "TOPIC{r}", "", _TOPIC)]),
    "jn05_types": _rows("file text type n", [(_N, *x) for x in _TYPED]),
    "jn07_references": _rows("file text ref symbol", [(_N, *x) for x in _REFERENCES]),
    "jn08_statics": _rows("file text value", [(_N, "TOPIC{r}", "topic-{r}"), (_N, "prefix", "/r{r}")]),
    "jn09_value_symbols": _rows("file text decl n", [*[(_N, x, _value(x), n) for x, n in (("REGISTRY{n}", 1), ("app", 2), ("pool", 1), ("prefix", 1), ("rows{n}", 1))], (_N, "TOPIC{r}", _TOPIC, 1), *[(_N, f"this.{x}", _id("property", f"Nation{{n}}.{x}"), n) for x, n in (("consumer", 2), ("producer", 1), ("store", 1))]]),
    "jn10_imports": _rows(_EDGES, _IMPORT_EDGES),
    "jn11_calls": _rows("src dst orders", _CALL_ORDERS),
    "jn12_unresolved": _rows("expression file line", [("nowhere{n}", _N, 25)]),
    "jn13_endpoints": _rows("file method path handler n_evidence", [(_N, "GET", "/n/{n}", _HELPER, 1), (_N, "POST", "/r{r}/things", _HELPER, 2)]),
    "jn15_tables": _rows("file owner table_name operation", [(_N, *x) for x in _ACCESSES]),
    "jn17_topics": _rows(_EDGES, _TOPICS),
    "jn19_interfaces": _rows(_EDGES, _INTERFACES),
    "jn21_injected": _rows(_EDGES, _INJECTED),
    "jn23_dispatch": _rows(_EDGES, _DISPATCH),
    "snk03_provenance": "WITH nodes AS (" + _BUILT_NODES + "), edges AS (" + _rows(_EDGES, _ALL_EDGES) + ") SELECT a.name AS from_name, b.name AS to_name, e.type AS relation, certainty, rule AS derivation, n_evidence > 0 AS proven, CAST(1 AS INT) AS confidence FROM edges AS e JOIN nodes AS a ON a.id = src JOIN nodes AS b ON b.id = dst",
    "bld01_edges": _rows(_EDGES, _ALL_EDGES),
    "bld02_nodes": _BUILT_NODES,
}

"""Semantic rules: each turns a resolved program into nodes and edges with evidence; an edge exists only if proved.

Rules return rows src, dst, type, rule, certainty, evidence (an array of places), seq and, for calls, the occurrence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import join_route, table_token
from tessella.operators.upsert import call_order
from tessella.plans.resolution import Program, last
from tessella.session import materialize

#: Fixed values of the rules: route verbs, clients, and what methods of a table client do.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
CLIENTS = ("Pool", "Client")
TABLE_METHODS = {"read": "SELECT", "select": "SELECT", "exists": "SELECT", "paginate": "SELECT", "aggregate": "SELECT", "search": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "upsert": "UPSERT"}
PLACE = "struct<file:string,line:int,column:int>"
OCCURRENCE = "struct<line:int,column:int,order:int>"


@dataclass
class Built:
    """The graph of a program: nodes, edges, and calls that nothing resolves."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("file", "line", "column")])


def edge(rows: DataFrame, src: str, dst: str, kind: Column, rule: str, evidence: Column, *, certainty: str = "DEFINITE", occurrence: Column | None = None) -> DataFrame:
    found = occurrence if occurrence is not None else F.lit(None).cast(OCCURRENCE)
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("type"), F.lit(rule).alias("rule"), F.lit(certainty).alias("certainty"), evidence.cast(f"array<{PLACE}>").alias("evidence"), found.cast(OCCURRENCE).alias("occurrence"), F.struct("file", "seq").alias("seq"))


def calls(program: Program) -> DataFrame:
    """CALL facts with their callee: file, seq, line, column, owner, expr, callee, callee_kind, method, receiver_expr, optional."""
    at = program.exprs.select("file", F.col("expr").alias("callee"), F.col("kind").alias("callee_kind"), F.col("name").alias("method"), F.col("base").alias("receiver_expr"), F.coalesce("optional", F.lit(False)).alias("optional"), F.col("text").alias("callee_text"))
    made = program.exprs.where("kind = 'CALL'").select("file", "expr", F.col("base").alias("callee"))
    return program.facts.where("kind = 'CALL'").select("file", "seq", "line", "column", "owner", "expr").join(made, ["file", "expr"]).join(at, ["file", "callee"])


def argument(program: Program, index: int, name: str) -> DataFrame:
    """file, expr and, as `name`, the argument's expression, with its kind."""
    own = program.arguments.where(F.col("index") == index).select("file", "expr", F.col("argument").alias(name))
    return own.join(program.exprs.select("file", F.col("expr").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("value").alias(f"{name}_value")), ["file", name])


def entry(program: Program, key: str, of: str, name: str) -> DataFrame:
    """file, `of` (an object literal) and, as `name`, its entry under key, with its kind."""
    own = last(program.entries.where(F.col("key") == key).select("file", F.col("expr").alias(of), F.col("entry").alias(name)), ["file", of], F.col(name))
    return own.join(program.exprs.select("file", F.col("expr").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("value").alias(f"{name}_value")), ["file", name])


def refers(program: Program, of: str, prefix: str) -> DataFrame:
    """file, `of` and what the expression refers to: {prefix}_ref, {prefix}_symbol, {prefix}_receiver."""
    return program.references.select("file", F.col("expr").alias(of), F.col("ref").alias(f"{prefix}_ref"), F.col("symbol").alias(f"{prefix}_symbol"), F.col("receiver").alias(f"{prefix}_receiver"))


def typed(program: Program, of: str, name: str) -> DataFrame:
    return program.types.select("file", F.col("expr").alias(of), F.col("type").alias(name))


def import_edges(program: Program) -> DataFrame:
    bound = program.facts.where("kind = 'IMPORT'").select("file", "seq", "line", "column", F.explode("bindings.local").alias("local"))
    found = bound.join(program.imports.where("module IS NOT NULL").select("file", "local", "module"), ["file", "local"])
    ids = found.withColumn("src", F.concat(F.lit("module:"), "file")).withColumn("dst", F.concat(F.lit("module:"), "module"))
    return edge(ids, "src", "dst", F.lit("IMPORTS"), "syntax", F.array(place()))


def call_edges(program: Program, sites: DataFrame) -> DataFrame:
    """Calls of methods and functions by methods and functions, numbered in the order of the source."""
    own = sites.where("owner.kind IN ('METHOD', 'FUNCTION')").join(refers(program, "callee", "to"), ["file", "callee"]).where("to_ref IN ('METHOD', 'FUNCTION')")
    numbered = call_order(own.select("file", F.col("seq").alias("fact_seq"), "seq", "line", "column", F.col("owner.id").alias("src"), F.col("to_symbol.id").alias("dst")), "src")
    return edge(numbered, "src", "dst", F.lit("CALLS"), "symbol-resolution", F.array(place()), occurrence=F.struct("line", "column", "order"))


def unresolved_calls(program: Program, sites: DataFrame, handled: DataFrame) -> DataFrame:
    """Calls of callable owners that nothing resolves and no rule has read at that place."""
    own = sites.where("owner.kind IN ('METHOD', 'FUNCTION')").join(refers(program, "callee", "to"), ["file", "callee"], "left_anti")
    rest = own.join(handled.select("file", "line", "column").distinct(), ["file", "line", "column"], "left_anti")
    return rest.select(F.col("callee_text").alias("expression"), "file", "line", F.lit("no binding and receiver type could be established").alias("reason"))


def endpoints(program: Program, sites: DataFrame) -> DataFrame:
    """file, seq, line, column, method, path, handler (a symbol), evidence of the routes."""
    on_members = sites.where("callee_kind = 'MEMBER' AND NOT optional").join(typed(program, "receiver_expr", "receiver"), ["file", "receiver_expr"], "left")
    served = F.coalesce((F.col("receiver.kind") == "EXTERNAL") & (F.col("receiver.module") == "fastify"), F.lit(False))
    on_members = materialize(on_members.withColumn("served", served), "members-called")
    register = on_members.where("method = 'register' AND served").join(argument(program, 0, "plugin"), ["file", "expr"]).join(refers(program, "plugin", "plugin"), ["file", "plugin"]).where("plugin_ref = 'FUNCTION'")
    prefixed = register.join(argument(program, 1, "options"), ["file", "expr"], "left").join(entry(program, "prefix", "options", "prefix"), ["file", "options"], "left")
    prefixed = prefixed.join(program.statics.select("file", F.col("expr").alias("prefix"), F.col("text").alias("prefix_text")), ["file", "prefix"], "left")
    with_place = prefixed.select(F.col("plugin_symbol.id").alias("plugin_id"), "file", "seq", "prefix_text", F.when(F.col("prefix_text").isNotNull(), place()).alias("prefix_place"))
    plugins = materialize(last(with_place, ["plugin_id"], F.struct("file", "seq")).select("plugin_id", "prefix_text", "prefix_place"), "plugins")
    routes = on_members.where(F.col("method").isin(*VERBS)).join(plugins.withColumnRenamed("plugin_id", "owner_id"), F.col("owner.id") == F.col("owner_id"), "left")
    receiver = program.exprs.where("kind = 'IDENTIFIER'").select("file", F.col("expr").alias("receiver_expr"), F.col("name").alias("receiver_name"))
    parameters = program.facts.where("kind = 'ARGUMENT' AND name IS NOT NULL").select("file", F.col("owner.id").alias("owner_id"), F.col("name").alias("receiver_name"), F.lit(True).alias("is_parameter")).distinct()
    routes = routes.join(receiver, ["file", "receiver_expr"], "left").join(parameters, ["file", "owner_id", "receiver_name"], "left").where("served OR (owner_id IS NOT NULL AND is_parameter)")
    routes = routes.join(argument(program, 0, "route"), ["file", "expr"]).where("route_kind = 'STRING_LITERAL'")
    routes = routes.join(argument(program, 1, "second"), ["file", "expr"], "left").join(argument(program, 2, "third"), ["file", "expr"], "left").join(entry(program, "handler", "second", "inside"), ["file", "second"], "left")
    handler = F.coalesce("third", F.when(F.col("second_kind") == "OBJECT_LITERAL", F.col("inside")).otherwise(F.col("second")))
    found = routes.withColumn("handler_expr", handler).join(refers(program, "handler_expr", "handler"), ["file", "handler_expr"]).where("handler_ref IN ('METHOD', 'FUNCTION')")
    proofs = F.array_compact(F.array(place(), F.col("prefix_place")))
    return found.select("file", "seq", "line", "column", F.upper("method").alias("method"), join_route(F.coalesce("prefix_text", F.lit("")), F.col("route_value")).alias("path"), F.col("handler_symbol").alias("handler"), proofs.alias("evidence"))


def table_accesses(program: Program, sites: DataFrame) -> DataFrame:
    """file, seq, line, column, owner, table, operation."""
    on_members = sites.where("callee_kind = 'MEMBER'")
    queried = on_members.where("method = 'query'").join(refers(program, "callee", "to"), ["file", "callee"]).where((F.col("to_ref") == "EXTERNAL") & (F.col("to_receiver.module") == "pg") & F.col("to_receiver.name").isin(*CLIENTS))
    queried = queried.join(argument(program, 0, "sql"), ["file", "expr"]).where("sql_kind = 'STRING_LITERAL'").select("file", "seq", "line", "column", "owner", table_token(F.col("sql_value")).alias("table"), F.lit("INSERT").alias("operation"))

    variables = program.facts.where("kind = 'VARIABLE' AND expr IS NOT NULL").select("file", "seq", "name", "expr").join(program.exprs.select("file", "expr", "kind", "base"), ["file", "expr"])
    callee = program.exprs.select("file", F.col("expr").alias("base"), F.col("kind").alias("base_kind"), F.col("name").alias("base_name"), F.col("base").alias("object"))
    made = variables.where("kind = 'CALL'").join(callee, ["file", "base"])
    from_library = program.imports.where("source = 'drizzle-orm/pg-core' AND imported = 'pgTable'").select("file", F.col("local").alias("base_name"))
    tables = made.where("base_kind = 'IDENTIFIER'").join(from_library, ["file", "base_name"], "left_semi").join(argument(program, 0, "first"), ["file", "expr"]).where("first_kind = 'STRING_LITERAL'")
    # One name for several tables stands for none until it is declared again: folded in the order of the files.
    fold = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("file", "seq", "first_value"))), lambda x: x["first_value"]), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (a == x), x))
    unique = tables.groupBy("name").agg(fold.alias("table")).where("table IS NOT NULL").select(F.lit("table").alias("holder"), "name", F.lit("").alias("key"), "table")
    frozen = made.where("base_kind = 'MEMBER' AND base_name = 'freeze'").join(program.exprs.where("kind = 'IDENTIFIER' AND name = 'Object'").select("file", F.col("expr").alias("object")), ["file", "object"], "left_semi").join(argument(program, 0, "literal"), ["file", "expr"]).select("file", "seq", "name", "literal", F.col("literal_kind").alias("kind"))
    literals = frozen.unionByName(variables.select("file", "seq", "name", F.col("expr").alias("literal"), "kind")).where("kind = 'OBJECT_LITERAL'")
    inner = literals.join(program.entries.select("file", F.col("expr").alias("literal"), "key", F.col("entry").alias("expr")), ["file", "literal"]).join(program.exprs.where("kind = 'CALL'").select("file", "expr"), ["file", "expr"], "left_semi")
    named = inner.join(argument(program, 0, "definition"), ["file", "expr"]).where("definition_kind = 'OBJECT_LITERAL'").join(entry(program, "name", "definition", "spelled"), ["file", "definition"]).where("spelled_kind = 'STRING_LITERAL'")
    registries = last(named.groupBy("file", "seq", "name").agg(F.collect_list(F.struct("key", F.col("spelled_value").alias("table"))).alias("all")), ["name"], F.struct("file", "seq")).select("name", F.explode("all").alias("e")).select(F.lit("registry").alias("holder"), "name", "e.key", "e.table")
    catalog = materialize(unique.unionByName(registries), "tables")

    operations = F.create_map(*[F.lit(x) for pair in TABLE_METHODS.items() for x in pair])
    used = on_members.where(F.col("method").isin(*TABLE_METHODS)).join(argument(program, 0, "first"), ["file", "expr"]).join(argument(program, 1, "second"), ["file", "expr"], "left")
    options = F.when(F.col("second_kind") == "OBJECT_LITERAL", F.col("second")).when(F.col("first_kind") == "OBJECT_LITERAL", F.col("first"))
    used = used.withColumn("options", options).join(entry(program, "table", "options", "given"), ["file", "options"], "left").withColumn("table_expr", F.coalesce("given", "first"))
    shape = program.exprs.select("file", F.col("expr").alias("table_expr"), F.col("kind").alias("table_kind"), F.col("name").alias("table_name"), F.col("base").alias("table_base"))
    owner_of = program.exprs.where("kind = 'IDENTIFIER'").select("file", F.col("expr").alias("table_base"), F.col("name").alias("registry"))
    used = used.join(shape, ["file", "table_expr"]).join(owner_of, ["file", "table_base"], "left")
    local = F.when(F.col("table_kind") == "MEMBER", F.col("registry")).when(F.col("table_kind") == "IDENTIFIER", F.col("table_name"))
    used = used.withColumn("local", local).where("local IS NOT NULL").join(program.imports.select("file", "local", "imported"), ["file", "local"], "left")
    used = used.withColumn("name", F.when(F.coalesce(F.col("imported"), F.lit("default")) == "default", F.col("local")).otherwise(F.col("imported"))).withColumn("holder", F.when(F.col("table_kind") == "MEMBER", "registry").otherwise("table")).withColumn("key", F.when(F.col("table_kind") == "MEMBER", F.col("table_name")).otherwise(""))
    structured = used.join(catalog, ["holder", "name", "key"]).select("file", "seq", "line", "column", "owner", "table", operations[F.col("method")].alias("operation"))
    return queried.unionByName(structured).where("table IS NOT NULL")


def interface_calls(program: Program, sites: DataFrame) -> DataFrame:
    """Calls of interface methods on a known value: file, seq, line, column, owner, method, declared (a symbol), property."""
    own = sites.where("callee_kind = 'MEMBER'").join(refers(program, "callee", "to"), ["file", "callee"]).where("to_ref = 'METHOD' AND to_receiver.kind = 'INTERFACE'")
    held = own.join(program.value_symbols.select("file", F.col("expr").alias("receiver_expr"), F.col("decl").alias("property")), ["file", "receiver_expr"])
    return held.select("file", "seq", "line", "column", "owner", "method", F.col("to_symbol").alias("declared"), "property")


def constructions(program: Program) -> DataFrame:
    """file, seq, line, column, expr, property, interface, argument, argument_kind: arguments that meet interface properties."""
    made = program.facts.where("kind = 'NEW'").select("file", "seq", "line", "column", "expr").join(typed(program, "expr", "service"), ["file", "expr"]).where("service.kind = 'CLASS'")
    meant = program.properties.where("index IS NOT NULL").select(F.col("class").alias("class_id"), F.col("symbol.id").alias("property"), F.col("symbol.module").alias("module"), F.col("type").alias("name"), "index")
    typed_properties = meant.join(program.type_names.select(F.col("file").alias("module"), "name", F.col("type").alias("interface")), ["module", "name"]).where("interface.kind = 'INTERFACE'").select("class_id", "property", "index", "interface")
    given = program.arguments.select("file", "expr", "index", "argument").join(program.exprs.select("file", F.col("expr").alias("argument"), F.col("kind").alias("argument_kind"), F.col("base").alias("argument_base")), ["file", "argument"])
    return made.withColumn("class_id", F.col("service.id")).join(typed_properties, "class_id").join(given, ["file", "expr", "index"])


def dependency_edges(program: Program, dispatched: DataFrame, built: DataFrame) -> DataFrame:
    """DEPENDS_ON, IMPLEMENTS, INJECTED_WITH and RESOLVES_TO of interfaces."""
    names = program.type_names.select("file", "name", "type").where("type.kind = 'INTERFACE'").select("file", F.col("name").alias("type_name"), F.col("type.id").alias("interface"))
    implemented = program.facts.where("kind = 'CLASS'").select("file", "seq", "line", "column", F.col("symbol.id").alias("class"), F.explode("implemented").alias("type_name")).join(names, ["file", "type_name"])
    implemented = materialize(implemented, "implemented")
    needs = program.facts.where("kind = 'CLASS_PROPERTY' AND owner.kind = 'CLASS'").select("file", "seq", "line", "column", F.col("owner.id").alias("class"), F.col("type").alias("type_name")).join(names, ["file", "type_name"])
    pairs = implemented.select(F.col("class").alias("implementation"), F.col("interface").alias("interface_id")).distinct()
    injected = built.join(typed(program, "argument", "made"), ["file", "argument"]).where("made.kind = 'CLASS'").withColumn("implementation", F.col("made.id")).withColumn("interface_id", F.col("interface.id")).join(pairs, ["implementation", "interface_id"], "left_semi")
    injected = materialize(injected.select("file", "seq", "line", "column", "property", "implementation"), "injected")
    by_property = injected.select("property", F.col("implementation").alias("container"), place().alias("injected_at"))
    dispatch = dispatched.join(by_property, "property").join(program.methods.select("container", F.col("name").alias("method"), F.col("symbol.id").alias("concrete")), ["container", "method"])
    dispatch = dispatch.withColumn("src", F.col("declared.id"))
    rule = "interface-di"
    return reduce(DataFrame.unionByName, [
        edge(needs, "class", "interface", F.lit("DEPENDS_ON"), rule, F.array(place())),
        edge(implemented, "class", "interface", F.lit("IMPLEMENTS"), rule, F.array(place())),
        edge(injected, "property", "implementation", F.lit("INJECTED_WITH"), rule, F.array(place())),
        edge(dispatch, "src", "concrete", F.lit("RESOLVES_TO"), rule, F.array(place(), F.col("injected_at"))),
    ])


def factory_edges(program: Program, dispatched: DataFrame, built: DataFrame) -> DataFrame:
    """INJECTED_WITH and RESOLVES_TO of factories whose branch is known, POSSIBLE_RESOLUTION where it is not.

    A factory's returns are read in the order of their lines: a condition that is false skips its return, a true one
    ends the search unless one before was unknown, and an unknown one makes the choice possible only.
    """
    names = program.type_names.where("type.kind = 'INTERFACE'").select("file", F.col("name").alias("returns"), F.col("type.id").alias("interface_id"))
    first_parameter = program.facts.where("kind = 'ARGUMENT' AND name IS NOT NULL").groupBy("file", F.col("owner.id").alias("factory")).agg(F.min_by("name", F.struct("index", "seq")).alias("parameter"))
    factories = program.functions.select("file", F.col("symbol.id").alias("factory"), F.col("type").alias("returns")).join(names, ["file", "returns"]).join(first_parameter, ["file", "factory"], "left").select("factory", "interface_id", "parameter")
    returned = program.facts.where("kind = 'RETURN' AND owner.kind = 'FUNCTION'").select("file", "seq", "line", "column", F.col("owner.id").alias("factory"), "expr", "condition")
    new = program.exprs.where("kind = 'NEW'").select("file", "expr")
    returned = returned.join(new, ["file", "expr"], "left_semi").join(typed(program, "expr", "made"), ["file", "expr"]).where("made.kind = 'CLASS'")
    test = program.exprs.where("kind = 'BINARY'").select("file", F.col("expr").alias("condition"), "operator", "left", "right")
    member = program.exprs.where("kind = 'MEMBER'").select("file", F.col("expr").alias("left"), F.col("name").alias("asked"), F.col("base").alias("asked_base"))
    asked = program.exprs.where("kind = 'IDENTIFIER'").select("file", F.col("expr").alias("asked_base"), F.col("name").alias("asked_parameter"))
    literal = program.exprs.where("kind = 'STRING_LITERAL'").select("file", F.col("expr").alias("right"), F.col("value").alias("wanted"))
    returned = returned.join(test, ["file", "condition"], "left").join(member, ["file", "left"], "left").join(asked, ["file", "asked_base"], "left").join(literal, ["file", "right"], "left")
    returned = returned.select("factory", "seq", F.col("made.id").alias("implementation"), "condition", "operator", "asked", "asked_parameter", "wanted", place().alias("returned_at"))
    used = built.where("argument_kind = 'CALL'").join(refers(program, "argument_base", "factory"), ["file", "argument_base"]).where("factory_ref = 'FUNCTION'").withColumn("factory", F.col("factory_symbol.id"))
    used = used.join(factories, "factory").where("interface_id = interface.id").join(argument(program, 0, "given").withColumnRenamed("expr", "argument"), ["file", "argument"], "left")
    used = used.select("file", "seq", "line", "column", "property", "factory", "parameter", "given", F.coalesce(F.col("given_kind") == "OBJECT_LITERAL", F.lit(False)).alias("literal"))
    tried = used.join(returned.withColumnRenamed("seq", "return_seq"), "factory")
    actual = program.entries.join(program.exprs.where("kind = 'STRING_LITERAL'").select("file", F.col("expr").alias("entry"), F.col("value").alias("actual")), ["file", "entry"]).select("file", F.col("expr").alias("given"), F.col("key").alias("asked"), "actual")
    tried = tried.join(actual, ["file", "given", "asked"], "left")
    fits = F.col("operator").isin("===", "==") & (F.col("asked_parameter") == F.col("parameter")) & F.col("literal")
    holds = F.when(F.col("condition").isNull(), True).when(fits, F.col("actual") == F.col("wanted"))
    by = Window.partitionBy("file", "seq", "property", "factory").orderBy("returned_at.line", "return_seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    unknown, true = F.col("holds").isNull().cast("int"), F.coalesce(F.col("holds"), F.lit(False)).cast("int")
    tried = tried.withColumn("holds", holds).withColumn("unknown_before", F.coalesce(F.max(unknown).over(before), F.lit(0)))
    # The search ends at the first true return that no unknown one precedes.
    ending = F.when((true == 1) & (F.col("unknown_before") == 0), 1).otherwise(0)
    tried = tried.withColumn("ended", F.coalesce(F.max(ending).over(before), F.lit(0))).where("ended = 0 AND (holds IS NULL OR holds)")
    whole = Window.partitionBy("file", "seq", "property", "factory")
    chosen = materialize(tried.withColumn("dynamic", F.max(unknown).over(whole) == 1), "chosen")
    definite = chosen.where("NOT dynamic")
    sent = dispatched.select("property", "method", F.col("owner.id").alias("caller"), place().alias("called_at"))
    resolved = chosen.join(sent, "property").withColumn("container", F.col("implementation")).join(program.methods.select("container", F.col("name").alias("method"), F.col("symbol.id").alias("concrete")), ["container", "method"])
    proofs, rule = F.array(F.col("called_at"), place(), F.col("returned_at")), "conditional-factory-analysis"
    return reduce(DataFrame.unionByName, [
        edge(definite, "property", "implementation", F.lit("INJECTED_WITH"), rule, F.array(place(), F.col("returned_at"))),
        edge(resolved.where("NOT dynamic"), "caller", "concrete", F.lit("RESOLVES_TO"), rule, proofs),
        edge(resolved.where("dynamic"), "caller", "concrete", F.lit("POSSIBLE_RESOLUTION"), rule, proofs, certainty="POSSIBLE"),
    ])


def topics(program: Program, sites: DataFrame) -> DataFrame:
    """PUBLISHES and CONSUMED_BY edges; the topic's name is the id without its prefix."""
    to = sites.where("callee_kind = 'MEMBER'").join(refers(program, "callee", "to"), ["file", "callee"]).where("to_ref = 'EXTERNAL' AND to_receiver.module = 'kafkajs'")
    to = to.join(argument(program, 0, "options"), ["file", "expr"]).where("options_kind = 'OBJECT_LITERAL'")
    on_topic = to.join(entry(program, "topic", "options", "topic"), ["file", "options"]).join(program.statics.select("file", F.col("expr").alias("topic"), F.col("text").alias("topic_name")), ["file", "topic"])
    on_topic = on_topic.withColumn("topic_id", F.concat(F.lit("topic:"), "topic_name"))
    sent = on_topic.where("method = 'send' AND to_receiver.name = 'Producer'").withColumn("src", F.col("owner.id"))
    receiver = program.value_symbols.select("file", F.col("expr").alias("receiver_expr"), F.col("decl").alias("receiver"))
    order = F.struct("file", "seq")
    subscribed = on_topic.where("method = 'subscribe' AND to_receiver.name = 'Consumer'").join(receiver, ["file", "receiver_expr"]).select("receiver", "file", "seq", "topic_id", place().alias("subscribed_at"))
    run = to.where("method = 'run' AND to_receiver.name = 'Consumer'").join(receiver, ["file", "receiver_expr"]).join(entry(program, "eachMessage", "options", "handler_expr"), ["file", "options"]).join(refers(program, "handler_expr", "handler"), ["file", "handler_expr"]).where("handler_ref = 'METHOD'")
    run = run.select("receiver", "file", "seq", F.col("handler_symbol.id").alias("handler"), place().alias("run_at"))
    consumed = last(subscribed, ["receiver"], order).join(last(run, ["receiver"], order).select("receiver", "handler", "run_at"), "receiver")
    return edge(sent, "src", "topic_id", F.lit("PUBLISHES"), "kafka-event", F.array(place())).unionByName(edge(consumed, "topic_id", "handler", F.lit("CONSUMED_BY"), "kafka-event", F.array(F.col("subscribed_at"), F.col("run_at"))))


def build(program: Program) -> Built:
    """All rules together: the first row of a key keeps its rule, evidence is united, occurrences are listed in order."""
    sites = materialize(calls(program), "calls")
    routes, accesses = materialize(endpoints(program, sites), "endpoints"), materialize(table_accesses(program, sites), "accesses")
    dispatched, built = materialize(interface_calls(program, sites), "interface-calls"), materialize(constructions(program), "constructions")
    route_rows = routes.withColumn("src", F.concat(F.lit("http:"), "method", F.lit(":"), "path")).withColumn("dst", F.col("handler.id"))
    table_rows = accesses.withColumn("src", F.col("owner.id")).withColumn("dst", F.concat(F.lit("table:"), "table"))
    access = F.when(F.col("operation") == "SELECT", "READS").otherwise("WRITES")
    parts = [
        import_edges(program),
        call_edges(program, sites),
        edge(route_rows, "src", "dst", F.lit("HANDLES"), "fastify-route", F.col("evidence")),
        edge(table_rows, "src", "dst", access, "sql-table-access", F.array(place())),
        dependency_edges(program, dispatched, built),
        factory_edges(program, dispatched, built),
        topics(program, sites),
    ]
    rows = materialize(reduce(DataFrame.unionByName, [p.withColumn("rank", F.lit(i)) for i, p in enumerate(parts)]), "edge-rows")
    seq = F.struct("rank", "seq")
    listed = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("k"), "evidence"))), lambda x: x["evidence"])))
    edges = rows.groupBy("src", "dst", "type").agg(F.min_by("rule", seq).alias("rule"), F.min_by("certainty", seq).alias("certainty"), listed.alias("evidence"), F.array_sort(F.array_distinct(F.transform(F.collect_list("occurrence"), lambda o: F.struct(o["order"].alias("order"), o["line"].alias("line"), o["column"].alias("column"))))).alias("occurrences"))

    module = program.files.select(F.concat(F.lit("module:"), "file").alias("id"), F.lit("MODULE").alias("type"), F.col("file").alias("name"), "file", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(-1).alias("seq"))
    kinds = ("CLASS", "INTERFACE", "CLASS_PROPERTY", "METHOD", "FUNCTION")
    declared = program.facts.where(F.col("symbol.kind").isin(*kinds)).select(F.col("symbol.id").alias("id"), F.col("symbol.kind").alias("type"), F.col("symbol.name").alias("name"), "file", "line", "column", "seq")
    http = routes.select(F.concat(F.lit("http:"), "method", F.lit(":"), "path").alias("id"), F.lit("HTTP_ENDPOINT").alias("type"), F.concat("method", F.lit(" "), "path").alias("name"), "file", "line", "column", "seq")
    found = reduce(DataFrame.unionByName, [module, declared, http]).withColumn("placed", F.lit(True))
    table = accesses.select(F.concat(F.lit("table:"), "table").alias("id"), F.lit("DATABASE_TABLE").alias("type"), F.col("table").alias("name"), "file", "line", "column", "seq")
    ends = rows.where("type IN ('PUBLISHES', 'CONSUMED_BY')").withColumn("id", F.when(F.col("type") == "PUBLISHES", F.col("dst")).otherwise(F.col("src")))
    topic = ends.select("id", F.lit("EVENT_TOPIC").alias("type"), F.expr("substring(id, 7)").alias("name"), F.explode("evidence").alias("p"), "seq").select("id", "type", "name", "p.file", "p.line", "p.column", F.col("seq.seq").alias("seq"))
    found = found.unionByName(table.unionByName(topic).withColumn("placed", F.lit(False)))
    order = F.struct("file", "seq")
    nodes = found.groupBy("id").agg(F.min_by(F.struct("type", "name", F.when(F.col("placed"), F.col("file")).alias("file"), F.when(F.col("placed"), F.col("line")).alias("line")), order).alias("n"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("file", "seq", "line", "column"))), lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["column"].alias("column")))).alias("evidence"))
    handled = routes.select(F.explode("evidence").alias("p")).select("p.*").unionByName(accesses.select("file", "line", "column"))
    return Built(nodes.select("id", "n.*", "evidence"), edges, unresolved_calls(program, sites, handled))

"""Name and type resolution over facts, as joins.

Declarations become dimension tables of which the last in the order of files and facts wins; imports become a table of
what each local name stands for. Types of expressions and declarations depend on each other along initializers and
member chains, so they grow in rounds from those known at once until none is added. A round joins on keys only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import normalize_path
from tessella.session import materialize

#: Suffixes tried for a relative import and for one of a workspace package, in order: fixed values.
RELATIVE = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PACKAGE = RELATIVE[1:]
_SYM = "struct<id:string,kind:string,module:string,name:string>"


def sym(s: str | Column, module: str | Column) -> Column:
    """A symbol of the facts with the module that declares it."""
    s = F.col(s) if isinstance(s, str) else s
    return F.struct(s["id"].alias("id"), s["kind"].alias("kind"), (F.col(module) if isinstance(module, str) else module).alias("module"), s["name"].alias("name"))


def external(source: Column, name: Column) -> Column:
    return F.struct(F.concat(F.lit("external:"), source, F.lit("#"), name).alias("id"), F.lit("EXTERNAL").alias("kind"), source.alias("module"), name.alias("name"))


def last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


@dataclass
class Program:
    """Facts and expressions of a set of files, and what their names and types resolve to."""

    facts: DataFrame
    exprs: DataFrame
    arguments: DataFrame
    entries: DataFrame
    files: DataFrame
    imports: DataFrame
    imported: DataFrame
    functions: DataFrame
    classes: DataFrame
    methods: DataFrame
    values: DataFrame
    properties: DataFrame
    type_names: DataFrame
    types: DataFrame
    references: DataFrame
    statics: DataFrame
    value_symbols: DataFrame


def _modules_of(paths: DataFrame, files: DataFrame) -> DataFrame:
    """file, source, module: the first existing file that an import path may mean; paths: file, source."""
    source = F.col("source")
    parts = F.split(source, "/")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/")
    base = F.concat(F.lit("src/packages/"), parts[1], F.lit("/src"), F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest)))
    joined = normalize_path(F.concat(F.regexp_replace("file", r"[^/]*$", ""), source))
    swapped = F.when(joined.endswith(".js"), F.concat(F.regexp_replace(joined, r"\.js$", ""), F.lit(".ts")))
    relative = F.array(*[F.concat(joined, F.lit(x)) for x in RELATIVE], swapped)
    package = F.array(*[F.concat(base, F.lit(x)) for x in PACKAGE])
    tried = paths.distinct().withColumn("candidates", F.when(source.startswith("@") & (F.size(parts) > 1), package).when(source.startswith("."), relative))
    each = tried.select("file", "source", F.posexplode("candidates").alias("pos", "module")).where(F.col("module").isNotNull())
    found = each.join(files.select(F.col("file").alias("module")), "module", "left_semi")
    return found.groupBy("file", "source").agg(F.min_by("module", "pos").alias("module"))


def _reexport_closure(files: DataFrame, reexports: DataFrame) -> DataFrame:
    """file, module, ord: modules whose exports a file passes on, itself first, in depth-first order of ord."""
    own = files.select("file", F.col("file").alias("module"), F.array().cast("array<int>").alias("ord"))
    steps = reexports.select(F.col("file").alias("module"), F.col("module").alias("next"), "seq")
    closure = frontier = materialize(own, "closure")
    while True:
        onward = frontier.join(steps, "module").select("file", F.col("next").alias("module"), F.concat("ord", F.array("seq")).alias("ord"))
        fresh = onward.groupBy("file", "module").agg(F.min("ord").alias("ord")).join(closure.select("file", "module"), ["file", "module"], "left_anti")
        frontier = materialize(fresh, "closure")
        if not frontier.limit(1).count():
            return closure
        closure = closure.unionByName(frontier)


def resolve(parsed: DataFrame) -> Program:
    """Resolve all names and types of parsed files (see sources.facts)."""
    parsed = parsed.where("problem IS NULL")
    keep = lambda df, name: materialize(df, name)
    facts = keep(parsed.select("file", F.explode("facts").alias("f")).select("file", "f.*"), "facts")
    exprs = keep(parsed.select("file", F.explode("exprs").alias("e")).select("file", "e.*"), "exprs")
    arguments = keep(parsed.select("file", F.explode("arguments").alias("a")).select("file", "a.*"), "arguments")
    entries = keep(parsed.select("file", F.explode("entries").alias("o")).select("file", "o.*"), "entries")
    files = keep(parsed.select("file").distinct(), "files")
    order = F.struct("file", "seq")

    named = facts.where(F.col("symbol").isNotNull()).select("file", "seq", "kind", F.col("symbol.name").alias("name"), sym("symbol", "file").alias("symbol"), "type", "exported")
    pick = lambda kind: last(named.where(F.col("kind") == kind), ["file", "name"], order)
    classes, interfaces, functions = (keep(pick(k), k.lower()) for k in ("CLASS", "INTERFACE", "FUNCTION"))
    method_rows = facts.where("kind = 'METHOD'").select(F.col("owner.id").alias("container"), F.element_at(F.split("symbol.name", r"\."), -1).alias("name"), sym("symbol", "file").alias("symbol"), "file", "seq")
    methods = keep(last(method_rows, ["container", "name"], order).select("container", "name", "symbol"), "methods")
    value_rows = facts.where("kind = 'VARIABLE'").select(F.col("owner.id").alias("scope"), "name", F.col("symbol.id").alias("decl"), "file", "seq", "expr", F.coalesce("exported", F.lit(False)).alias("exported"), F.col("owner.kind").alias("scope_kind"))
    values = keep(last(value_rows, ["scope", "name"], order), "values")
    property_rows = facts.where("kind = 'CLASS_PROPERTY'").select(F.col("owner.id").alias("class"), "name", sym("symbol", "file").alias("symbol"), "file", "seq", "expr", "type", "index")
    properties = keep(last(property_rows, ["class", "name"], order), "properties")

    paths = facts.where("kind IN ('IMPORT', 'EXPORT') AND source IS NOT NULL").select("file", "source")
    modules = keep(_modules_of(paths, files), "modules")
    bound = facts.where("kind = 'IMPORT'").select("file", "seq", "source", F.posexplode("bindings").alias("pos", "b")).select("file", F.col("b.local").alias("local"), "seq", "pos", "source", F.col("b.imported").alias("imported"))
    imports = keep(last(bound, ["file", "local"], F.struct("seq", "pos")).join(modules, ["file", "source"], "left").select("file", "local", "source", "imported", "module", "seq"), "imports")
    reexports = facts.where("kind = 'EXPORT' AND source IS NOT NULL").join(modules, ["file", "source"]).select("file", "module", "seq")
    closure = _reexport_closure(files, reexports)
    symbols = [d.select(F.col("file").alias("module"), "name", F.lit(i).alias("rank"), "symbol", F.lit(None).cast("string").alias("decl")) for i, d in enumerate((classes, interfaces, functions))]
    exported = values.where("exported AND scope_kind = 'MODULE'").select(F.col("file").alias("module"), "name", F.lit(3).alias("rank"), F.lit(None).cast(_SYM).alias("symbol"), "decl")
    direct = reduce(DataFrame.unionByName, [*symbols, exported])
    wanted = imports.withColumn("name", F.when(F.col("imported") == "default", F.col("local")).otherwise(F.col("imported")))
    inside = wanted.where("module IS NOT NULL").select("file", "local", "name", F.col("module").alias("from"))
    passed = inside.join(closure.select(F.col("file").alias("from"), "module", "ord"), "from").join(direct, ["module", "name"])
    internal = passed.groupBy("file", "local").agg(F.min_by(F.struct("symbol", "decl"), F.struct("ord", "rank")).alias("r")).select("file", "local", "r.symbol", "r.decl")
    outside = wanted.where("module IS NULL").select("file", "local", external(F.col("source"), F.col("name")).alias("symbol"), F.lit(None).cast("string").alias("decl"))
    imported = keep(internal.unionByName(outside), "imported")

    # What a name means in a file as a type: an imported symbol, else a class, else an interface of its own.
    usable = F.col("symbol.kind").isin("CLASS", "INTERFACE", "EXTERNAL")
    taken = imported.where("symbol IS NOT NULL").select("file", F.col("local").alias("name"), F.when(usable, F.col("symbol")).alias("type"), F.lit(0).alias("rank"))
    local_types = [d.select("file", "name", F.col("symbol").alias("type"), F.lit(i).alias("rank")) for i, d in enumerate((classes, interfaces), 1)]
    type_names = keep(reduce(DataFrame.unionByName, [taken, *local_types]).groupBy("file", "name").agg(F.min_by(F.struct("type"), "rank").alias("r")).select("file", "name", "r.type").where("type IS NOT NULL"), "type-names")

    def own_class(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("file", "name", F.col("symbol").alias("class_type")), ["file", "name"], "left")

    def from_imports(rows: DataFrame) -> DataFrame:
        return rows.join(imported.select("file", F.col("local").alias("name"), F.col("symbol").alias("imported_symbol"), F.col("decl").alias("imported_decl")), ["file", "name"], "left")

    # Identifiers: a local value, else an import, else a class.
    scoped = lambda name, scope: values.select(F.col("scope").alias(scope), "name", F.col("decl").alias(name))
    identifiers = exprs.where("kind = 'IDENTIFIER'").select("file", "expr", "name", F.col("owner.id").alias("own_scope"), F.concat(F.lit("module:"), "file").alias("module_scope"))
    identifiers = from_imports(identifiers.join(scoped("own", "own_scope"), ["own_scope", "name"], "left").join(scoped("outer", "module_scope"), ["module_scope", "name"], "left"))
    identifiers = own_class(identifiers).withColumn("local", F.coalesce("own", "outer"))
    no_local, no_import = F.col("local").isNull(), F.col("imported_symbol").isNull() & F.col("imported_decl").isNull()
    identifiers = keep(identifiers.withColumn("decl", F.coalesce("local", "imported_decl")).withColumn("type", F.when(no_local & F.col("imported_symbol").isNotNull(), F.col("imported_symbol")).when(no_local & no_import, F.col("class_type"))), "identifiers")
    base = exprs.select("file", F.col("expr").alias("base"), F.col("kind").alias("base_kind"), F.col("name").alias("base_name"))
    made = exprs.where("kind = 'NEW'").select("file", "expr", "base").join(base, ["file", "base"]).where("base_kind = 'IDENTIFIER'").select("file", "expr", F.col("base_name").alias("name"))
    made = own_class(from_imports(made))
    made = made.select("file", "expr", F.col("imported_decl").alias("decl"), F.when(F.col("imported_decl").isNull(), F.coalesce("imported_symbol", "class_type")).alias("type"))
    this = exprs.where("kind = 'THIS' AND owner.kind = 'METHOD'").select("file", "expr", F.col("owner.container").alias("id")).join(classes.select(F.col("symbol.id").alias("id"), F.col("symbol").alias("type")), "id").select("file", "expr", F.lit(None).cast("string").alias("decl"), "type")

    # References without a receiver's type: functions, imported symbols, members of imported and local objects.
    local_function = functions.select("file", "name", F.col("symbol").alias("function"))
    plain = identifiers.join(local_function, ["file", "name"], "left").select("file", "expr", F.coalesce("imported_symbol", "function").alias("symbol")).where("symbol IS NOT NULL")
    members = exprs.where("kind = 'MEMBER'").select("file", "expr", F.col("name").alias("property"), "base", "owner")
    on_names = members.join(identifiers.select("file", F.col("expr").alias("base"), F.col("name").alias("object"), "local"), ["file", "base"])
    on_names = on_names.join(imports.select("file", F.col("local").alias("object"), "module", "imported"), ["file", "object"], "left")
    there = F.concat(F.when(F.col("imported") == "default", F.col("object")).otherwise(F.col("imported")), F.lit("."), "property")
    far = functions.select(F.col("file").alias("module"), F.col("name").alias("there"), F.col("symbol").alias("far"))
    near = functions.select("file", F.col("name").alias("here"), F.col("symbol").alias("near"))
    on_names = on_names.withColumn("there", there).withColumn("here", F.when(F.col("local").isNotNull(), F.concat("object", F.lit("."), "property")))
    object_functions = keep(on_names.join(far, ["module", "there"], "left").join(near, ["file", "here"], "left").select("file", "expr", F.coalesce("far", "near").alias("symbol")).where("symbol IS NOT NULL"), "object-functions")
    typed_members = keep(members.join(object_functions.select("file", "expr"), ["file", "expr"], "left_anti").select("file", "expr", "property", "base"), "members")
    all_members = members.select("file", "expr", "property", "base")
    calls = keep(exprs.where("kind = 'CALL'").select("file", "expr", "base"), "calls")
    plain = keep(plain, "plain")

    # Rounds of types: T of expressions and D of declarations.
    declared = keep(values.select("decl", "file", "expr", F.lit(None).cast("string").alias("type_name")).unionByName(properties.select(F.col("symbol.id").alias("decl"), "file", "expr", F.col("type").alias("type_name"))).dropDuplicates(["decl"]), "declared")
    kinds = exprs.select("file", "expr", F.col("kind").alias("expr_kind"))
    hints = declared.join(type_names.select("file", F.col("name").alias("type_name"), "type"), ["file", "type_name"]).join(kinds, ["file", "expr"], "left")
    hints = keep(hints.select("decl", "type", F.coalesce(F.col("expr_kind").isin("IDENTIFIER", "THIS", "NEW", "CALL", "MEMBER"), F.lit(False)).alias("late")), "hints")
    point = materialize(identifiers.select("file", "expr", "decl", "type").unionByName(made).unionByName(this), "points")
    outer_calls = calls.join(plain.select("file", F.col("expr").alias("base"), "symbol"), ["file", "base"]).where("symbol.kind = 'EXTERNAL'").select("file", "expr", F.col("symbol").alias("type"))
    fixed = keep(point.where("type IS NOT NULL AND decl IS NULL").select("file", "expr", "type").unionByName(outer_calls), "fixed")
    pointing = keep(point.where("decl IS NOT NULL").select("file", "expr", "decl"), "pointing")
    property_decl = properties.select(F.col("class").alias("class_id"), F.col("name").alias("property"), F.col("symbol.id").alias("decl"))
    types, late, size = fixed, False, -1
    decl_types = hints.where("NOT late").select("decl", "type")
    while True:
        from_decls = pointing.join(decl_types, "decl").select("file", "expr", "type")
        held = types.select("file", F.col("expr").alias("base"), F.col("type").alias("base_type"))
        on_types = all_members.join(held, ["file", "base"])
        inner = on_types.where("base_type.kind IN ('CLASS', 'INTERFACE')").withColumn("class_id", F.col("base_type.id")).join(property_decl, ["class_id", "property"]).join(decl_types, "decl").select("file", "expr", "type")
        outer_members = typed_members.join(held, ["file", "base"]).where("base_type.kind = 'EXTERNAL'")
        outer = outer_members.select("file", F.col("expr").alias("base"), external(F.col("base_type.module"), F.concat("base_type.name", F.lit("."), "property")).alias("type"))
        called = calls.join(outer, ["file", "base"]).select("file", "expr", "type")
        types = keep(reduce(DataFrame.unionByName, [fixed, from_decls, inner, called]).dropDuplicates(["file", "expr"]), "types")
        known = declared.join(types.select("file", "expr", "type"), ["file", "expr"]).select("decl", "type")
        spare = hints.where("NOT late" if not late else "true").select("decl", "type").join(known.select("decl"), "decl", "left_anti")
        decl_types = keep(known.unionByName(spare), "decl-types")
        now = types.count() + decl_types.count()
        if now == size:
            if late:
                break
            late = True
        size = now

    # References of any expression, with the receiver's type where one decides.
    none = F.lit(None).cast(_SYM)
    receivers = typed_members.join(types.select("file", F.col("expr").alias("base"), F.col("type").alias("receiver")), ["file", "base"])
    outer = receivers.where("receiver.kind = 'EXTERNAL'").select("file", "expr", external(F.col("receiver.module"), F.concat("receiver.name", F.lit("."), "property")).alias("symbol"), "receiver", F.lit("EXTERNAL").alias("ref"))
    inner = receivers.where("receiver.kind IN ('CLASS', 'INTERFACE')").withColumn("class_id", F.col("receiver.id")).join(methods.select(F.col("container").alias("class_id"), F.col("name").alias("property"), "symbol"), ["class_id", "property"]).select("file", "expr", "symbol", "receiver", F.lit("METHOD").alias("ref"))
    ref = F.when(F.col("symbol.kind").isin("FUNCTION", "EXTERNAL"), F.col("symbol.kind")).otherwise("METHOD")
    references = reduce(DataFrame.unionByName, [plain.select("file", "expr", "symbol", none.alias("receiver"), ref.alias("ref")), object_functions.select("file", "expr", "symbol", none.alias("receiver"), F.lit("FUNCTION").alias("ref")), outer, inner])

    # Static strings follow names to their initializers.
    texts = keep(exprs.where("kind = 'STRING_LITERAL'").select("file", "expr", F.col("value").alias("text")), "texts")
    statics, size = texts, -1
    while (now := statics.count()) != size:
        size = now
        named_texts = pointing.join(declared.select("decl", F.col("file").alias("decl_file"), F.col("expr").alias("decl_expr")), "decl").join(statics.select(F.col("file").alias("decl_file"), F.col("expr").alias("decl_expr"), "text"), ["decl_file", "decl_expr"]).select("file", "expr", "text")
        # A "new" points to a declaration for its type only.
        named_texts = named_texts.join(identifiers.select("file", "expr"), ["file", "expr"], "left_semi")
        statics = keep(texts.unionByName(named_texts).dropDuplicates(["file", "expr"]), "statics")

    # Values behind expressions: variables, and properties of this.
    on_this = members.join(this.select("file", F.col("expr").alias("base"), F.col("type.id").alias("class_id")), ["file", "base"]).join(property_decl, ["class_id", "property"]).select("file", "expr", "decl")
    value_symbols = identifiers.where("decl IS NOT NULL").select("file", "expr", "decl").unionByName(on_this)
    return Program(facts, exprs, arguments, entries, files, imports, imported, functions, classes, methods, values, properties, type_names, types, keep(references, "references"), statics, keep(value_symbols, "value-symbols"))

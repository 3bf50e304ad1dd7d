"""Facts: what a file's tree says, as flat rows.

A file gives facts (declarations, imports, calls, returns and so on, in the order of the text), its expressions as rows
that refer to their parts, the arguments of calls and the entries of object literals. Expressions are named by their
place, so rows of one file join on it; parentheses have no row of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.operators.upsert import fact_summary
from tessella.sources.syntax import Node, Places, SyntaxProblem, parse, unquoted

SYMBOL = "struct<id:string,kind:string,name:string,container:string>"
FACT = f"struct<seq:int,kind:string,line:int,column:int,end_line:int,end_column:int,symbol:{SYMBOL},owner:{SYMBOL},source:string,bindings:array<struct<imported:string,local:string>>,implemented:array<string>,expr:string,condition:string,name:string,value:string,type:string,exported:boolean,index:int>"
EXPR = f"struct<expr:string,kind:string,name:string,base:string,optional:boolean,value:string,operator:string,left:string,right:string,owner:{SYMBOL},text:string>"
PARSED = f"file string, problem string, facts array<{FACT}>, exprs array<{EXPR}>, arguments array<struct<expr:string,index:int,argument:string>>, entries array<struct<expr:string,key:string,entry:string>>"
_COMPARISONS = frozenset("=== !== == != > >= < <=".split())
_EXPRESSIONS = frozenset("identifier this member subscript call new string object array binary arrow function_expression unary update await yield assignment ternary sequence as non_null tagged number regex true false null undefined super spread import_call markup".split())


def symbol(kind: str, file: str, name: str, container: str | None = None) -> dict:
    spelled = {"MODULE": f"module:{file}", "CLASS": f"class:{file}#{name}", "INTERFACE": f"interface:{file}#{name}", "METHOD": f"method:{file}#{name}", "FUNCTION": f"function:{file}#{name}", "CLASS_PROPERTY": f"property:{file}#{name}", "VARIABLE": f"variable:{file}#{container}/{name}"}
    return {"id": spelled[kind], "kind": kind, "name": name, "container": container}


@dataclass(frozen=True)
class Around:
    """What holds a node: owner, class, interface, whether exported, declared variable, its member, nearest condition."""

    owner: dict
    cls: dict | None = None
    interface: dict | None = None
    exported: bool = False
    declared: str | None = None
    member: str | None = None
    condition: str | None = None


class Extractor:
    def __init__(self, file: str, text: str):
        self.file, self.text, self.places = file, text, Places(text)
        # The grammar with types has no elements, but angle assertions.
        self.markup = not file.lower().endswith(".ts")
        self.facts: list[dict] = []
        self.exprs: list[dict] = []
        self.arguments: list[dict] = []
        self.entries: list[dict] = []

    def run(self) -> None:
        tree = parse(self.text, markup=self.markup)
        self.walk(tree, Around(symbol("MODULE", self.file, self.file)))

    def name_of(self, node: Node | None) -> str | None:
        """The expression's name: its place; of parentheses, that of what they hold."""
        while node is not None and node.type == "paren":
            node = node.children[0]
        return None if node is None else f"{node.start}:{node.end}:{node.type}"

    def fact(self, kind: str, node: Node, around: Around, **more) -> None:
        line, column = self.places.of(node.start)
        end_line, end_column = self.places.of(node.end)
        self.facts.append({"seq": len(self.facts), "kind": kind, "line": line, "column": column, "end_line": end_line, "end_column": end_column, "owner": around.owner, **more})

    def expression(self, node: Node, around: Around) -> None:
        parts, name = node.parts, self.name_of(node)
        row = {"expr": name, "kind": "UNKNOWN", "owner": around.owner, "text": self.text[node.start : node.end]}
        if node.type == "identifier":
            row |= {"kind": "IDENTIFIER", "name": row["text"]}
        elif node.type == "this":
            row["kind"] = "THIS"
        elif node.type == "member":
            row |= {"kind": "MEMBER", "name": parts["property"], "base": self.name_of(parts["object"]), "optional": parts["optional"]}
        elif node.type in ("call", "new"):
            base = parts["callee" if node.type == "call" else "constructor"]
            row |= {"kind": node.type.upper(), "base": self.name_of(base)}
            self.arguments += [{"expr": name, "index": i, "argument": self.name_of(a)} for i, a in enumerate(parts["arguments"])]
        elif node.type == "string":
            row |= {"kind": "STRING_LITERAL", "value": unquoted(row["text"])}
        elif node.type == "object":
            row["kind"] = "OBJECT_LITERAL"
            pairs = {unquoted(c.parts["key"]): self.name_of(c.parts["value"]) for c in node.children if c.type == "pair"}
            for c in node.children:
                if c.type == "shorthand":
                    pairs[c.parts["name"]] = f"{c.start}:{c.end}:identifier"
                    self.exprs.append({"expr": pairs[c.parts["name"]], "kind": "IDENTIFIER", "name": c.parts["name"], "owner": around.owner, "text": c.parts["name"]})
            self.entries += [{"expr": name, "key": k, "entry": v} for k, v in pairs.items()]
        elif node.type == "array":
            row["kind"] = "ARRAY_LITERAL"
        elif node.type == "binary":
            operator = parts["operator"] if parts["operator"] in _COMPARISONS else ""
            row |= {"kind": "BINARY", "operator": operator, "left": self.name_of(parts["left"]), "right": self.name_of(parts["right"])}
        self.exprs.append(row)

    def parameters(self, node: Node, around: Around, owner: dict) -> None:
        at = replace(around, owner=owner)
        for i, p in enumerate(node.parts["parameters"]):
            name, kind = p.parts["name"], p.parts["annotation"]
            self.fact("ARGUMENT", p, at, name=name, type=kind, index=i)
            if kind:
                self.fact("TYPE_ANNOTATION", p, at, name=name, type=kind)
            if p.parts["access"] and owner["kind"] == "METHOD" and owner["name"].endswith(".constructor"):
                cls = owner["name"].removesuffix(".constructor")
                self.fact("CLASS_PROPERTY", p, replace(around, owner=symbol("CLASS", self.file, cls)), symbol=symbol("CLASS_PROPERTY", self.file, f"{cls}.{name}"), name=name, type=kind, index=i)

    def walk(self, node: Node, around: Around) -> None:
        for step in self.enter(node, around):
            for child in node.children:
                self.walk(child, step)

    def enter(self, node: Node, around: Around) -> Iterator[Around]:
        """Add the node's own facts; what its children stand in."""
        kind, parts, inner = node.type, node.parts, around
        if kind in _EXPRESSIONS:
            self.expression(node, around)
        if kind in ("program", "block", "class_body"):
            inner = replace(around, exported=False) if kind == "class_body" else replace(around, exported=False, declared=None, member=None)
        elif kind == "import":
            bindings = [{"imported": a, "local": b} for a, b in parts["bindings"]]
            self.fact("IMPORT", node, replace(around, owner=symbol("MODULE", self.file, self.file)), source=parts["source"], bindings=bindings)
        elif kind == "export":
            self.fact("EXPORT", node, replace(around, owner=symbol("MODULE", self.file, self.file)), source=parts["source"])
            inner = replace(around, exported=True)
        elif kind == "class":
            own = symbol("CLASS", self.file, parts["name"]) if parts["name"] else None
            if own:
                self.fact("CLASS", node, around, symbol=own, name=parts["name"], exported=around.exported, implemented=parts["implements"])
            inner = replace(around, cls=own)
        elif kind == "interface":
            own = symbol("INTERFACE", self.file, parts["name"])
            self.fact("INTERFACE", node, around, symbol=own, name=parts["name"], exported=around.exported)
            inner = replace(around, interface=own)
        elif kind in ("method", "method_signature"):
            holder = around.cls if kind == "method" else around.interface
            if holder:
                own = symbol("METHOD", self.file, f"{holder['name']}.{parts['name']}", holder["id"])
                self.fact("METHOD", node, replace(around, owner=holder), symbol=own, name=parts["name"])
                self.parameters(node, around, own)
                inner = replace(around, owner=own) if kind == "method" else around
        elif kind == "function" and parts["name"]:
            own = symbol("FUNCTION", self.file, parts["name"])
            self.fact("FUNCTION", node, replace(around, owner=symbol("MODULE", self.file, self.file)), symbol=own, name=parts["name"], exported=around.exported, type=parts["returns"])
            self.parameters(node, around, own)
            inner = replace(around, owner=own)
        elif kind in ("arrow", "function_expression") and around.member:
            own = symbol("FUNCTION", self.file, around.member)
            self.fact("FUNCTION", node, replace(around, owner=symbol("MODULE", self.file, self.file)), symbol=own, name=around.member, exported=around.exported)
            self.parameters(node, around, own)
            inner = replace(around, owner=own)
        elif kind == "field" and around.cls:
            own = symbol("CLASS_PROPERTY", self.file, f"{around.cls['name']}.{parts['name']}")
            self.fact("CLASS_PROPERTY", node, replace(around, owner=around.cls), symbol=own, name=parts["name"], expr=self.name_of(parts["value"]), type=parts["annotation"])
        elif kind == "declarator":
            own = symbol("VARIABLE", self.file, parts["name"], around.owner["id"])
            self.fact("VARIABLE", node, around, symbol=own, name=parts["name"], expr=self.name_of(parts["value"]), exported=around.exported)
            inner = replace(around, declared=parts["name"], member=None)
        elif kind == "pair":
            if around.declared and not around.member:
                inner = replace(around, member=f"{around.declared}.{unquoted(parts['key'])}")
        elif kind == "call":
            self.fact("CALL", node, around, expr=self.name_of(node))
            for i, a in enumerate(parts["arguments"]):
                self.fact("ARGUMENT", a, around, expr=self.name_of(a), index=i)
        elif kind in ("member", "new", "object"):
            self.fact(kind.upper(), node, around, expr=self.name_of(node))
        elif kind == "string":
            self.fact("STRING", node, around, expr=self.name_of(node), value=unquoted(self.text[node.start : node.end]))
        elif kind == "if":
            self.fact("CONDITION", node, around, expr=self.name_of(parts["condition"]))
            inner = replace(around, condition=self.name_of(parts["condition"]))
        elif kind == "return":
            self.fact("RETURN", node, around, expr=self.name_of(node.children[0]) if node.children else None, condition=around.condition)
        yield inner


def parse_files(files: DataFrame) -> DataFrame:
    """One row a file: its facts and expressions, or the problem that skips it. files: file, content."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, problem = Extractor(file or "", content or ""), None
                try:
                    found.run()
                except SyntaxProblem as e:
                    found, problem = Extractor(file or "", ""), str(e)
                row = {"file": file, "problem": problem, "facts": found.facts, "exprs": found.exprs, "arguments": found.arguments, "entries": found.entries}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("file", "content").mapInArrow(run, PARSED)


def facts(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.explode("facts").alias("f")).select("file", "f.*")


def summary(parsed: DataFrame) -> DataFrame:
    """kind, file, n: facts by kind, by file and in all."""
    return fact_summary(facts(parsed))

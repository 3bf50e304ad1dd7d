"""Graph documents: the JSON form of a built graph, read leniently and written back.

A document has nodes (id, type, name, file, line), edges (from, to, type, provenance) and unresolved calls. Ids are
read as text, a missing name is the id, a missing type "symbol"; kinds become lower case; an edge's place is its first
evidence by the parser, else its first evidence. A document without nodes or edges is an error.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.labels import confidence_label
from tessella.plans.graph import Graph
from tessella.plans.rules import Built

EVIDENCE = "array<struct<provider:string,file:string,line:int,column:int>>"
DOCUMENT = f"nodes array<struct<id:string,type:string,name:string,file:string,line:int,method:string,path:string,evidence:{EVIDENCE}>>, edges array<struct<from:string,to:string,type:string,provenance:struct<evidence:{EVIDENCE},derivation:struct<kind:string,rule:string>,confidence:double,certainty:string,occurrences:array<struct<line:int,column:int,order:int>>>>>, unresolved array<struct<expression:string,file:string,line:int,reason:string>>"


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of one document, or of a folder of them."""
    documents = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    if documents.where("nodes IS NULL OR edges IS NULL").limit(1).count():
        raise ValueError(f"not a graph: nodes and edges are expected in {path}")
    n = documents.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = n.select("id", F.coalesce("name", "id").alias("label"), F.lower(F.coalesce("type", F.lit("symbol"))).alias("kind"), "file", "line")
    e = documents.select(F.explode("edges").alias("e")).select("e.*")
    proofs = F.col("provenance.evidence")
    best = F.coalesce(F.get(F.filter(proofs, lambda x: x["provider"] == "treesitter"), F.lit(0)), F.get(proofs, F.lit(0)))
    certainty = F.col("provenance.certainty")
    occurrences = F.transform("provenance.occurrences", lambda o: F.struct(o["order"].alias("order"), o["line"].alias("line"), o["column"].alias("column")))
    edges = e.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("type").alias("relation"), F.coalesce(certainty, F.lit("DEFINITE")).alias("certainty"), best["line"].alias("line"), F.lit(None).cast("int").alias("call_order"), best["file"].alias("file"), best["column"].alias("column"), confidence_label(certainty).alias("confidence"), F.col("provenance.confidence").alias("confidence_score"), occurrences.alias("occurrences"))
    return Graph(nodes, edges)


def as_graph(built: Built) -> Graph:
    """A built graph as the queries read it."""
    nodes = built.nodes.select("id", F.col("name").alias("label"), F.lower("type").alias("kind"), "file", "line")
    first = F.get("evidence", F.lit(0))
    edges = built.edges.select("src", "dst", F.col("type").alias("relation"), "certainty", first["line"].alias("line"), F.lit(None).cast("int").alias("call_order"), first["file"].alias("file"), first["column"].alias("column"), confidence_label(F.col("certainty")).alias("confidence"), F.lit(1.0).alias("confidence_score"), "occurrences")
    return Graph(nodes, edges)


def _rows(built: Built) -> dict[str, DataFrame]:
    """The documents' parts as one JSON text a row, in order."""
    places = F.transform("evidence", lambda p: F.struct(F.lit("treesitter").alias("provider"), p["file"].alias("file"), p["line"].alias("line"), p["column"].alias("column")))
    method, path = F.regexp_extract("name", r"^([A-Z]+) (/.*)$", 1), F.regexp_extract("name", r"^([A-Z]+) (/.*)$", 2)
    http = F.col("type") == "HTTP_ENDPOINT"
    nodes = built.nodes.select("id", F.to_json(F.struct("id", "type", "name", "file", "line", F.when(http, method).alias("method"), F.when(http, path).alias("path"), places.alias("evidence"))).alias("json"))
    syntactic = F.col("rule").isin("syntax", "symbol-resolution")
    derivation = F.struct(F.when(syntactic, F.col("rule")).otherwise("semantic-rule").alias("kind"), F.when(~syntactic, F.col("rule")).alias("rule"))
    provenance = F.struct(places.alias("evidence"), derivation.alias("derivation"), F.lit(1).alias("confidence"), "certainty", F.when(F.size("occurrences") > 0, F.col("occurrences")).alias("occurrences"))
    edges = built.edges.select("src", "dst", "type", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type", provenance.alias("provenance"))).alias("json"))
    rest = built.unresolved.select("file", "line", "expression", F.to_json(F.struct("expression", "file", "line", "reason")).alias("json"))
    return {"nodes": nodes.orderBy("id"), "edges": edges.orderBy("src", "dst", "type"), "unresolved": rest.orderBy("file", "line", "expression")}


def write_graph(built: Built, path: str) -> None:
    """One document at a local path, written row by row, so the driver never holds a graph."""
    with open(path, "w", encoding="utf-8") as out:
        for i, (name, rows) in enumerate(_rows(built).items()):
            out.write(("{" if i == 0 else ",") + json.dumps(name) + ":[")
            for j, row in enumerate(rows.select("json").toLocalIterator()):
                out.write("," * bool(j) + row["json"])
            out.write("]")
        out.write("}")


def write_parts(built: Built, path: str) -> None:
    """The same rows as JSON lines in the folders nodes, edges and unresolved of path, by all executors."""
    for name, rows in _rows(built).items():
        rows.select(F.col("json").alias("value")).write.text(f"{path}/{name}")

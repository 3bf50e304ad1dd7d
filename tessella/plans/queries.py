"""Registered queries of the graph engine over the projections of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.operators import filters, neighbours, paths, ranking, sequence, surfaces, traces, traversal, upsert
from tessella.plans.graph import Graph
from tessella.plans.projections import load
from tessella.plans.source_queries import SOURCE_QUERIES

CUSTOMER, EVENT, REGION = "method:customer#C.7", "view", "region:1"


def _services(spark: SparkSession, sf_dir: str) -> Graph:
    return load(spark, sf_dir, "services")


def _transitions(spark: SparkSession, sf_dir: str) -> Graph:
    return load(spark, sf_dir, "transitions").stored()


def _lineage(spark: SparkSession, sf_dir: str, depth: int = 2) -> tuple[Graph, DataFrame, DataFrame]:
    graph = _services(spark, sf_dir).stored()
    return graph, traversal.lineage_nodes(graph, CUSTOMER, depth), traversal.lineage_edges(graph, CUSTOMER, depth)


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the same lineage alone."""
    return traversal.lineage_nodes(_services(spark, sf_dir).stored(), CUSTOMER, 2)


def _text(path: str):
    return F.array_join(path, " > ")


def gr01_lineage_nodes(spark, sf_dir):
    return _near(spark, sf_dir).select("id", "label", "kind", "hop")


def gr01_lineage_edges(spark, sf_dir):
    return traversal.lineage_edges(_services(spark, sf_dir).stored(), CUSTOMER, 2)


def gr01_cyclic_nodes(spark, sf_dir):
    return traversal.hops(_transitions(spark, sf_dir), EVENT)


def gr01_cyclic_edges(spark, sf_dir):
    return traversal.lineage_edges(_transitions(spark, sf_dir), EVENT)


def gr01_cyclic_edges_bounded(spark, sf_dir):
    return traversal.lineage_edges(_transitions(spark, sf_dir), EVENT, 1)


def gr01_paths(spark, sf_dir):
    return traversal.lineage_paths(_services(spark, sf_dir).stored(), CUSTOMER, 2).select("direction", _text("path").alias("path"))


def gr02_ranked_paths(spark, sf_dir):
    graph = _transitions(spark, sf_dir)
    ranked = ranking.score_paths(graph, traversal.lineage_paths(graph, EVENT))
    place = F.row_number().over(Window.partitionBy("direction").orderBy(*ranking.rank_order())).cast("long")
    return ranked.select("direction", _text("path").alias("path"), "score", place.alias("place"))


def gr03_traces(spark, sf_dir):
    return traces.traces(_services(spark, sf_dir).stored(), CUSTOMER, 3).select("direction", _text("labels").alias("trace"), F.col("rank").cast("long").alias("place"))


def gr03_trace_nodes(spark, sf_dir):
    graph = _services(spark, sf_dir).stored()
    return traces.trace_nodes(traces.traces(graph, CUSTOMER, 3), graph.target(CUSTOMER))


def gr04_maximal_paths(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.array_compact(F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "[./]"), lambda x: x != "")).alias("labels"))
    return traces.without_contained(pages).select(_text("labels").alias("path")).distinct()


def gr05_node_scores(spark, sf_dir):
    graph = _services(spark, sf_dir)
    return graph.nodes.where("kind = 'method'").select("id", ranking.node_score(F.col("label"), F.col("file")).cast("long").alias("score"))


def gr06_label_scores(spark, sf_dir):
    graph = _services(spark, sf_dir)
    named = graph.nodes.select("id", F.array(L.format_label(F.col("label"), F.col("file")), F.lit("routerHandler"), F.lit("createApp")).alias("labels"))
    return named.select("id", ranking.label_score(F.col("labels")).cast("long").alias("score"))


def gr07_impact_nodes(spark, sf_dir):
    return traces.impact_nodes(_services(spark, sf_dir), CUSTOMER)


def gr07_impact_edges(spark, sf_dir):
    return traces.impact_edges(_services(spark, sf_dir), CUSTOMER).select("src", "dst", "relation")


def gr07_impact_paths(spark, sf_dir):
    return traces.impact_paths(_services(spark, sf_dir).stored(), CUSTOMER, 1).select(_text("labels").alias("trace"))


def gr08_reachable(spark, sf_dir):
    return traversal.reachable(load(spark, sf_dir, "regions").stored(), REGION).select("id", F.col("depth").cast("long").alias("depth"))


def gr09_endpoints(spark, sf_dir):
    return surfaces.surface_endpoints(*_lineage(spark, sf_dir))


def gr09_tables(spark, sf_dir):
    return surfaces.surface_tables(*_lineage(spark, sf_dir)).select("id", "name", F.array_join("via", ",").alias("via"))


def gr09_publishes(spark, sf_dir):
    return surfaces.surface_publishes(*_lineage(spark, sf_dir)).select("id", "topic", F.array_join("via", ",").alias("via"))


def gr09_consumes(spark, sf_dir):
    return surfaces.surface_consumes(*_lineage(spark, sf_dir))


def gr10_endpoint_labels(spark, sf_dir):
    return _services(spark, sf_dir).nodes.select("id", L.endpoint(F.col("label")).alias("e")).where("e IS NOT NULL").select("id", "e.method", "e.path")


def gr11_sequence(spark, sf_dir):
    got = sequence.sequence(_services(spark, sf_dir).stored(), CUSTOMER).where("segment = 0")
    return got.select(F.array_join(F.col("step").cast("array<string>"), ".").alias("step"), "src", "dst", "relation", "certain", F.col("number").cast("long").alias("number"))


def gr11_async_segments(spark, sf_dir):
    got = sequence.sequence(_services(spark, sf_dir).stored(), CUSTOMER).where("segment > 0")
    return got.select("src", "dst", F.col("segment").cast("long").alias("segment"), F.col("number").cast("long").alias("number"))


def agg01_evidence_union(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("first_type"), F.array("event_type").alias("evidence"))
    return upsert.upsert(rows, ["user_id"], "seq", "evidence").select("user_id", "first_type", F.array_join("evidence", ",").alias("evidence"))


def agg02_edge_upsert(spark, sf_dir):
    """Events as evidence of edges from users to types: the first one's place, all distinct days in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").alias("seq"), F.col("event_id").alias("first_event"), F.array(F.date_format("ts", "yyyy-MM-dd")).alias("evidence"))
    return upsert.upsert(rows, ["src", "dst"], "seq", "evidence").select("src", "dst", "first_event", F.array_join("evidence", ",").alias("evidence"))


def agg03_summary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return upsert.fact_summary(docs.select(F.col("lang").alias("kind"), F.col("source").alias("file")))


def agg05_legend(spark, sf_dir):
    return neighbours.kind_counts(_services(spark, sf_dir)).select("kind", "n", F.col("place").cast("long").alias("place"))


def agg06_stats(spark, sf_dir):
    return traversal.lineage_stats(_services(spark, sf_dir).stored(), CUSTOMER, 2).select("node_count", "edge_count", F.col("max_hop").cast("long").alias("max_hop"))


def agg07_degrees(spark, sf_dir):
    return neighbours.degrees(_services(spark, sf_dir).edges)


def win01_call_order(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").alias("line"), F.lit(0).alias("column"), F.col("event_type").alias("file"), F.col("event_id").alias("fact_seq"))
    return upsert.call_order(calls, "user_id").select("user_id", "event_id", F.col("order").cast("long").alias("place"))


def win02_items(spark, sf_dir):
    return sequence.call_items(_services(spark, sf_dir).edges).select("src", F.col("item").cast("long").alias("item"), "dst", "relation", "certain")


def jn24_callers(spark, sf_dir):
    return neighbours.callers(_transitions(spark, sf_dir), EVENT).select("src", "dst", "relation", "label", "file")


def jn24_callees(spark, sf_dir):
    return neighbours.callees(_services(spark, sf_dir), CUSTOMER).select("src", "dst", "relation", "label", "kind", "file")


def jn25_provenance(spark, sf_dir):
    return neighbours.provenance_report(_services(spark, sf_dir))


def flt01_search(spark, sf_dir):
    return neighbours.search(_services(spark, sf_dir), "HANDLE1", 30).select("id", "label", "file")


def flt02_node(spark, sf_dir):
    return neighbours.node(_services(spark, sf_dir), CUSTOMER).select("id", "label", "kind", "file")


def flt05_concern(spark, sf_dir):
    graph, nodes, edges = _lineage(spark, sf_dir)
    return filters.concern_nodes(Graph(nodes, edges), CUSTOMER, "writes")


def flt06_direction(spark, sf_dir):
    return filters.direction_nodes(_near(spark, sf_dir), "upstream").select("id", "hop")


def flt07_induced(spark, sf_dir):
    _, nodes, edges = _lineage(spark, sf_dir)
    return filters.induced(edges, nodes.where("kind <> 'database_table'").select("id"))


def flt08_isolated(spark, sf_dir):
    return filters.isolated(_transitions(spark, sf_dir).edges, ["view", "click", "purchase"]).select("src", "dst", "relation")


def flt09_helpers(spark, sf_dir):
    _, nodes, edges = _lineage(spark, sf_dir)
    return filters.without_helpers(nodes, edges, CUSTOMER).select("id", "kind")


def flt10_reprojected(spark, sf_dir):
    graph = _transitions(spark, sf_dir)
    paths, ids = traversal.lineage_paths(graph, EVENT), graph.nodes.where("id <> 'error'").select("id")
    return filters.reprojected(paths, ids, filters.induced(graph.edges.where("line > 0"), ids)).groupBy("direction", _text("path").alias("path")).agg(F.count("*").alias("n"))


def srt02_symbols(spark, sf_dir):
    return neighbours.symbols(_services(spark, sf_dir), 200).select("id", "label", "file")


def srt05_best_path(spark, sf_dir):
    graph = _transitions(spark, sf_dir)
    return ranking.best_path(graph, traversal.lineage_paths(graph, EVENT)).select("direction", _text("path").alias("path"), F.col("score").cast("long").alias("score"))


def sc01_normalize(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", L.normalize_path(F.regexp_replace("url", "^([a-z]+)://", "$1/../x//./")).alias("path"))


def sc02_routes(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    prefix = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/"))).otherwise("")
    route = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/"), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise("")
    return nation.select("n_nationkey", L.join_route(prefix, route).alias("route"))


def sc03_table_tokens(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    start = F.when(F.col("n_nationkey") % 3 == 0, "  insert INTO ").when(F.col("n_nationkey") % 3 == 1, "INSERT\n into\t").otherwise("select 1 from ")
    return nation.select("n_nationkey", L.table_token(F.concat(start, F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("(a) values (1)"))).alias("table_name"))


def prj01_labels(spark, sf_dir):
    n = _services(spark, sf_dir).nodes
    return n.select("id", L.format_label(F.col("label"), F.col("file")).alias("name"), L.location_text(F.col("kind"), F.col("file"), F.col("line")).alias("place"), L.last_two_segments(F.col("file")).alias("tail"))


def sc09_escaped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(L.escape_html(F.col("text"))).alias("digest"), L.safe_filename(F.substring("text", 1, 60)).alias("file"))


def _ranked(spark, sf_dir):
    """The transitions' lineage: graph, ranked paths."""
    graph = _transitions(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("direction").orderBy(*ranking.rank_order()))
    return graph, ranking.score_paths(graph, traversal.lineage_paths(graph, EVENT)).withColumn("place", place)


def gr12_columns(spark, sf_dir):
    graph, found = _ranked(spark, sf_dir)
    return paths.layout_columns(traversal.lineage_nodes(graph, EVENT), found).select("id", F.col("column").cast("long").alias("place"))


def win07_column_ranks(spark, sf_dir):
    graph, found = _ranked(spark, sf_dir)
    ranks = paths.column_ranks(traversal.lineage_nodes(graph, EVENT), found)
    return ranks.select("id", F.col("column").cast("long").alias("place"), F.col("row").cast("long").alias("rank"))


def gr13_best_through(spark, sf_dir):
    return paths.best_through(_ranked(spark, sf_dir)[1]).select("id", _text("path").alias("path"))


def gr14_highlighted(spark, sf_dir):
    return paths.highlighted(_ranked(spark, sf_dir)[1], "purchase")[1]


def gr15_default_path(spark, sf_dir):
    return paths.default_path(_ranked(spark, sf_dir)[1]).select(_text("path").alias("path"))


def gr16_edges_between(spark, sf_dir):
    graph, found = _ranked(spark, sf_dir)
    return paths.edges_between(paths.highlighted(found, "purchase")[1], graph.edges)


def gr17_trace_steps(spark, sf_dir):
    graph, found = _ranked(spark, sf_dir)
    return graph.nodes.crossJoin(F.broadcast(paths.default_path(found))).select("id", paths.trace_step(F.col("path"), F.col("id")).cast("long").alias("step"))


def gr18_message_rows(spark, sf_dir):
    got = sequence.sequence(_services(spark, sf_dir).stored(), CUSTOMER, depth=2)
    return paths.message_rows(got).groupBy().agg(F.count("*").alias("n"), F.max("row").alias("last"), F.countDistinct("row").alias("n_rows"))


def win06_lanes(spark, sf_dir):
    graph = _transitions(spark, sf_dir)
    rows = graph.nodes.select("id", F.length("id").alias("row"))
    return paths.lanes(graph.edges, rows).select("src", "dst", "relation", F.col("lane").cast("long").alias("lane"))


def jn26_topic_flows(spark, sf_dir):
    return paths.topic_flows(_services(spark, sf_dir).edges).groupBy("topic", "consumer").agg(F.count("*").alias("n"))


def sc07_uri(spark, sf_dir):
    """Whole texts as URI components and back."""
    coded = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", L.uri_component(F.col("text")).alias("coded"))
    return coded.select("doc_id", F.md5("coded").alias("digest"), (L.uri_decoded(F.col("coded")) == F.col("text")).alias("same"))


def srt01_node_order(spark, sf_dir):
    """Customers' names in the order of languages."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("_"), "c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("#"), F.col("c_custkey").cast("string")).alias("name"))
    keyed = names.withColumn("key", F.collate("name", "UNICODE"))
    return upsert.numbered(keyed, [], ["key"], "place").select("c_custkey", "name", F.col("place").cast("long").alias("place"))


def srt03_node_list(spark, sf_dir):
    return traversal.node_list(_near(spark, sf_dir)).select("id", F.col("place").cast("long").alias("place"))


def srt10_edge_list(spark, sf_dir):
    graph, nodes, edges = _lineage(spark, sf_dir)
    return traversal.edge_list(edges, nodes).select("src", "dst", "relation", F.col("place").cast("long").alias("place"))


def gr18_step_texts(spark, sf_dir):
    got = sequence.sequence(_services(spark, sf_dir).stored(), CUSTOMER).where("segment = 0")
    return got.select("src", "dst", "relation", L.step_text(F.col("step"), F.col("certain")).alias("step"))


def flt03_noise(spark, sf_dir):
    n = _services(spark, sf_dir).nodes
    return n.select("id", L.is_noise(F.col("label"), F.col("kind"), F.col("file"), enabled=True).alias("noise"), L.node_kind(F.lit(None).cast("string"), F.lit(False), F.col("file")).alias("guess"))


def prj03_urls(spark, sf_dir):
    n = _services(spark, sf_dir).nodes
    return n.select("id", L.editor_url(F.col("file"), F.col("line"), "/work/tree/").alias("url"), L.css_colour(F.col("line")).alias("colour"))


def prj04_hops(spark, sf_dir):
    return _near(spark, sf_dir).select("id", L.hop_label(F.col("hop")).alias("hop"))


QUERIES = SOURCE_QUERIES | {name: f for name, f in list(globals().items()) if name[:2] in ("gr", "ag", "wi", "jn", "fl", "sr", "sc", "pr") and callable(f) and name[-1] != "_" and getattr(f, "__module__", "") == __name__}

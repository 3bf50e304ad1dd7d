"""Projections of relational tables onto the graph model, in SQL that Spark and the checking database both read.

services: nations are endpoints that customers handle, customers call their orders in the order of their dates, orders
read or write parts and publish to suppliers, which functions of the supplier's nation consume. transitions: an event
type calls the type of the same user's next event. regions: region, nation and customer as containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.graph import Graph

SERVICES_NODES = """
    SELECT 'http:GET:/nation/' || CAST(n_nationkey AS STRING) AS id, 'GET /nation/' || CAST(n_nationkey AS STRING) AS label, 'http_endpoint' AS kind, CAST(NULL AS STRING) AS file, CAST(NULL AS INT) AS line FROM {nation}
    UNION ALL SELECT 'method:customer#C.' || CAST(c_custkey AS STRING), '.handle' || CAST(c_custkey AS STRING) || '()', 'method', 'src/controllers/nation' || CAST(c_nationkey AS STRING) || '.ts', CAST(c_custkey AS INT) FROM {customer}
    UNION ALL SELECT 'method:order#O.' || CAST(o_orderkey AS STRING), 'process' || CAST(o_orderkey AS STRING), 'method', 'src/services/orders.ts', CAST(o_orderkey AS INT) FROM {orders}
    UNION ALL SELECT 'table:part' || CAST(p_partkey AS STRING), 'part' || CAST(p_partkey AS STRING), 'database_table', CAST(NULL AS STRING), CAST(NULL AS INT) FROM {part}
    UNION ALL SELECT 'topic:supplier' || CAST(s_suppkey AS STRING), 'supplier' || CAST(s_suppkey AS STRING), 'event_topic', CAST(NULL AS STRING), CAST(NULL AS INT) FROM {supplier}
    UNION ALL SELECT 'function:consumer#' || CAST(n_nationkey AS STRING), 'consume' || CAST(n_nationkey AS STRING), 'function', 'src/handlers/consumer.ts', CAST(n_nationkey AS INT) FROM {nation}"""
SERVICES_EDGES = """
    SELECT 'http:GET:/nation/' || CAST(c_nationkey AS STRING) AS src, 'method:customer#C.' || CAST(c_custkey AS STRING) AS dst, 'HANDLES' AS relation, 'DEFINITE' AS certainty, CAST(c_custkey AS INT) AS line, CAST(NULL AS INT) AS call_order FROM {customer}
    UNION ALL SELECT 'method:customer#C.' || CAST(o_custkey AS STRING), 'method:order#O.' || CAST(o_orderkey AS STRING), 'CALLS', CASE WHEN o_orderstatus = 'P' THEN 'POSSIBLE' ELSE 'DEFINITE' END, CAST(o_orderkey AS INT), CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) FROM {orders}
    UNION ALL SELECT 'method:order#O.' || CAST(l_orderkey AS STRING), 'table:part' || CAST(l_partkey AS STRING), CASE WHEN max(l_returnflag) = 'R' THEN 'WRITES' ELSE 'READS' END, 'DEFINITE', CAST(min(l_linenumber) AS INT), CAST(NULL AS INT) FROM {lineitem} GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 'method:order#O.' || CAST(l_orderkey AS STRING), 'topic:supplier' || CAST(l_suppkey AS STRING), 'PUBLISHES', 'DEFINITE', CAST(min(l_linenumber) AS INT), CAST(NULL AS INT) FROM {lineitem} GROUP BY l_orderkey, l_suppkey
    UNION ALL SELECT 'topic:supplier' || CAST(s_suppkey AS STRING), 'function:consumer#' || CAST(s_nationkey AS STRING), 'CONSUMED_BY', 'DEFINITE', CAST(s_suppkey AS INT), CAST(NULL AS INT) FROM {supplier}"""
TRANSITIONS_NODES = "SELECT DISTINCT event_type AS id, event_type AS label, 'function' AS kind, 'src/' || event_type || '.ts' AS file, CAST(NULL AS INT) AS line FROM {events}"
TRANSITIONS_EDGES = """
    SELECT src, dst, 'CALLS' AS relation, 'DEFINITE' AS certainty, CAST(count(*) AS INT) AS line, CAST(NULL AS INT) AS call_order
    FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}) AS t WHERE dst IS NOT NULL GROUP BY src, dst"""
REGIONS_NODES = """
    SELECT 'region:' || CAST(r_regionkey AS STRING) AS id, r_name AS label, 'module' AS kind, CAST(NULL AS STRING) AS file, CAST(NULL AS INT) AS line FROM {region}
    UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), n_name, 'class', CAST(NULL AS STRING), CAST(NULL AS INT) FROM {nation}
    UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), c_name, 'method', CAST(NULL AS STRING), CAST(NULL AS INT) FROM {customer}"""
REGIONS_EDGES = """
    SELECT 'region:' || CAST(n_regionkey AS STRING) AS src, 'nation:' || CAST(n_nationkey AS STRING) AS dst, 'CONTAINS' AS relation, 'DEFINITE' AS certainty, CAST(NULL AS INT) AS line, CAST(NULL AS INT) AS call_order FROM {nation}
    UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'CONTAINS', 'DEFINITE', CAST(NULL AS INT), CAST(NULL AS INT) FROM {customer}"""
PROJECTIONS = {"services": (SERVICES_NODES, SERVICES_EDGES), "transitions": (TRANSITIONS_NODES, TRANSITIONS_EDGES), "regions": (REGIONS_NODES, REGIONS_EDGES)}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The named projection of the tables in sf_dir."""
    nodes, edges = PROJECTIONS[name]

    def frame(sql: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
        return spark.sql(sql, **used)

    return Graph(frame(nodes), frame(edges))


def with_clauses(name: str) -> str:
    """nodes and edges of the projection as common table expressions over the tables."""
    nodes, edges = (sql.format(**{t: t for t in TABLES}) for sql in PROJECTIONS[name])
    return f"nodes AS ({nodes}), edges AS ({edges})"

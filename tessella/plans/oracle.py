"""The registered queries in plain SQL, for a second engine."""

from __future__ import annotations

from tessella.plans.projections import with_clauses
from tessella.plans.queries import CUSTOMER, EVENT, REGION
from tessella.plans.source_oracle import SOURCE_SQL


def _walk(name: str, target: str, direction: str, depth: int) -> str:
    """Rows of every simple walk: cur, path, ord, depth and the edge taken, down to depth + 1 steps."""
    near, far = ("dst", "src") if direction == "up" else ("src", "dst")
    bound = f"AND w.depth <= {depth}" if depth else ""
    return f"""{name} AS (
        SELECT id AS cur, [id] AS path, CAST([] AS VARCHAR[]) AS ord, 0 AS depth, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS relation FROM nodes WHERE id = '{target}'
        UNION ALL
        SELECT e.{far}, list_append(w.path, e.{far}), list_append(w.ord, e.{far} || chr(1) || e.relation), w.depth + 1, e.src, e.dst, e.relation
        FROM {name} AS w JOIN edges AS e ON e.{near} = w.cur JOIN nodes AS n ON n.id = e.{far} WHERE NOT list_contains(w.path, e.{far}) {bound})"""


def _walks(projection: str, target: str, depth: int) -> str:
    keep = f"depth <= {depth}" if depth else "true"
    ends = "".join(
        f""", {d}_ends AS (SELECT '{name}' AS direction, path, ord FROM {d} AS w WHERE depth > 0 AND {keep} AND NOT EXISTS (
            SELECT 1 FROM edges AS e JOIN nodes AS n ON n.id = e.{far} WHERE e.{near} = w.cur AND NOT list_contains(w.path, e.{far})))"""
        for d, name, near, far in (("up", "upstream", "dst", "src"), ("down", "downstream", "src", "dst"))
    )
    return f"""WITH RECURSIVE {with_clauses(projection).replace(' AS (', ' AS MATERIALIZED (', 1).replace('), edges AS (', '), edges AS MATERIALIZED (', 1)},
        {_walk('up', target, 'up', depth)}, {_walk('down', target, 'down', depth)},
        hop AS (SELECT cur AS id, CAST(arg_min(h, abs(h) * 2 + CASE WHEN h > 0 THEN 1 ELSE 0 END) AS INT) AS hop FROM (SELECT cur, -depth AS h FROM up UNION ALL SELECT cur, depth FROM down) GROUP BY cur),
        taken AS (SELECT DISTINCT src, dst, relation FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE src IS NOT NULL)
        {ends}, ends AS (SELECT * FROM up_ends UNION ALL SELECT * FROM down_ends)"""


_PLAIN = "regexp_replace({0}, '^\\.|\\(\\)$', '', 'g')"
_BASE = "regexp_extract({0}, '([^/\\\\]*)$', 1)"
_NAME = f"CASE WHEN coalesce(file, '') <> '' THEN {_PLAIN.format('label')} || ' (' || {_BASE.format('file')} || ')' ELSE {_PLAIN.format('label')} END"
_SERVICES, _SERVICES3, _EVENTS, _EVENTS1 = _walks("services", CUSTOMER, 2), _walks("services", CUSTOMER, 3), _walks("transitions", EVENT, 0), _walks("transitions", EVENT, 1)
_NODE_SCORE = f"""(CASE WHEN regexp_matches(p, '/routes?/|router') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(p, 'controller|handler') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(p, '/services?/') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(p, '/(repositories|repository|dao)/') THEN 1 ELSE 0 END)"""
_SCORES = f"points AS (SELECT id, 1 + {_NODE_SCORE} AS points FROM (SELECT id, lower(coalesce(file, '')) AS p FROM nodes))"
_SCORED = f"{_SCORES}, scored AS (SELECT direction, path, ord, (SELECT CAST(sum(points) AS INT) FROM points WHERE list_contains(path, id)) AS score FROM ends)"
_LABEL_SCORE = "(len({0}) + list_sum(list_transform({0}, lambda s: (CASE WHEN contains(lower(s), 'route') THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(lower(s), 'controller|handler') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(lower(s), 'buildapp|bootstrap|createapp') THEN -3 ELSE 0 END))))"


_RANKED = f"{_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY score DESC, len(path) DESC, ord) AS place FROM scored)"


def _traces(depth: int) -> str:
    return f"""{_walks('services', CUSTOMER, depth)},
        names AS (SELECT id, {_NAME} AS name FROM nodes),
        capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY ord) AS leaf FROM ends) WHERE leaf <= 40),
        named AS (SELECT direction, ord, any_value(path) AS path, list(name ORDER BY pos) AS labels FROM (SELECT direction, ord, path, unnest(path) AS id, generate_subscripts(path, 1) AS pos FROM capped) JOIN names USING (id) GROUP BY direction, ord),
        kept AS (SELECT direction, ord, path, labels FROM named AS a WHERE NOT EXISTS (SELECT 1 FROM named AS b WHERE a.direction = b.direction AND len(b.labels) > len(a.labels)
            AND contains(chr(1) || array_to_string(b.labels, chr(1)) || chr(1), chr(1) || array_to_string(a.labels, chr(1)) || chr(1)))),
        turned AS (SELECT direction, ord, path, CASE WHEN direction = 'upstream' THEN list_reverse(labels) ELSE labels END AS labels FROM kept),
        placed AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY {_LABEL_SCORE.format('labels')} DESC, len(labels) DESC, ord) AS r FROM turned)"""


def _services_only() -> str:
    return f"WITH {with_clauses('services')}"


_ITEMS = """items AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY coalesce(call_order, line, 9007199254740991), dst, relation) AS item, dst, relation, certainty <> 'POSSIBLE' AS certain FROM edges),
    scope AS (SELECT src, dst, relation, certain, [item] AS step, CASE WHEN relation IN ('PUBLISHES', 'CONSUMED_BY') THEN NULL ELSE dst END AS cur, [dst] AS visited, 1 AS depth FROM items WHERE src = '{0}'
        UNION ALL SELECT i.src, i.dst, i.relation, i.certain, list_append(s.step, i.item), CASE WHEN i.relation IN ('PUBLISHES', 'CONSUMED_BY') OR list_contains(s.visited, i.dst) THEN NULL ELSE i.dst END, list_append(s.visited, i.dst), s.depth + 1
        FROM scope AS s JOIN items AS i ON i.src = s.cur WHERE s.depth < 4)"""
_SEQUENCE = f"WITH RECURSIVE {with_clauses('services')}, {_ITEMS.format(CUSTOMER)}"

ORACLE_SQL = {
    "gr01_lineage_nodes": f"{_SERVICES} SELECT id, label, kind, hop FROM hop JOIN nodes USING (id)",
    "gr01_lineage_edges": f"{_SERVICES} SELECT src, dst, relation FROM taken",
    "gr01_cyclic_nodes": f"{_EVENTS} SELECT id, hop FROM hop",
    "gr01_cyclic_edges": f"{_EVENTS} SELECT src, dst, relation FROM taken",
    "gr01_cyclic_edges_bounded": f"{_EVENTS1} SELECT src, dst, relation FROM taken",
    "gr01_paths": f"{_SERVICES} SELECT direction, array_to_string(path, ' > ') AS path FROM ends",
    "gr02_ranked_paths": f"{_EVENTS}, {_SCORED} SELECT direction, array_to_string(path, ' > ') AS path, score, row_number() OVER (PARTITION BY direction ORDER BY score DESC, len(path) DESC, ord) AS place FROM scored",
    "gr03_traces": f"{_traces(3)} SELECT direction, array_to_string(labels, ' > ') AS trace, CASE WHEN r <= 12 THEN r END AS place FROM placed",
    "gr03_trace_nodes": f"{_traces(3)} SELECT DISTINCT unnest(path) AS id FROM placed UNION SELECT '{CUSTOMER}'",
    "gr04_maximal_paths": """WITH p AS (SELECT DISTINCT list_filter(string_split(replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '.', '/'), '/'), lambda x: x <> '') AS l FROM pages)
        SELECT array_to_string(l, ' > ') AS path FROM p AS a WHERE NOT EXISTS (SELECT 1 FROM p AS b WHERE len(b.l) > len(a.l) AND contains('/' || array_to_string(b.l, '/') || '/', '/' || array_to_string(a.l, '/') || '/'))""",
    "gr05_node_scores": f"{_services_only()} SELECT id, CAST({_NODE_SCORE} AS BIGINT) AS score FROM (SELECT id, lower(file) AS p FROM nodes WHERE kind = 'method')",
    "gr06_label_scores": f"{_services_only()} SELECT id, CAST({_LABEL_SCORE.format('l')} AS BIGINT) AS score FROM (SELECT id, [{_NAME}, 'routerHandler', 'createApp'] AS l FROM nodes)",
    "gr07_impact_nodes": f"{_services_only()} SELECT DISTINCT 'upstream' AS direction, src AS id FROM edges WHERE dst = '{CUSTOMER}' UNION SELECT 'downstream', dst FROM edges WHERE src = '{CUSTOMER}'",
    "gr07_impact_edges": f"{_services_only()} SELECT src, dst, relation FROM (SELECT *, 0 AS side FROM edges WHERE dst = '{CUSTOMER}' UNION ALL SELECT *, 1 FROM edges WHERE src = '{CUSTOMER}') ORDER BY side, src, dst, relation LIMIT 200",
    "gr07_impact_paths": f"{_traces(3)} SELECT array_to_string(labels, ' > ') AS trace FROM placed WHERE r <= 12 ORDER BY CASE WHEN direction = 'upstream' THEN 0 ELSE 1 END, r LIMIT 40",
    "gr08_reachable": f"""WITH RECURSIVE {with_clauses('regions')}, r AS (SELECT '{REGION}' AS id, 0 AS depth UNION ALL SELECT e.dst, depth + 1 FROM r JOIN edges AS e ON e.src = r.id)
        SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY id""",
    "gr09_endpoints": f"""{_SERVICES}, names AS (SELECT id, {_NAME} AS name FROM nodes)
        SELECT n.id, 'GET' AS method, substr(label, 5) AS path, coalesce((SELECT name FROM names WHERE names.id = (SELECT min(dst) FROM taken WHERE relation = 'HANDLES' AND src = n.id)), label) AS handler FROM nodes AS n JOIN hop USING (id) WHERE kind = 'http_endpoint'""",
    "gr09_tables": f"""{_SERVICES}, names AS (SELECT id, {_NAME} AS name FROM nodes)
        SELECT n.id, n.label AS name, coalesce((SELECT string_agg(x.name, ',' ORDER BY t.src, t.relation) FROM taken AS t JOIN names AS x ON x.id = t.src WHERE t.dst = n.id AND relation IN ('READS', 'WRITES')), n.label) AS via FROM nodes AS n JOIN hop USING (id) WHERE kind = 'database_table'""",
    "gr09_publishes": f"""{_SERVICES}, names AS (SELECT id, {_NAME} AS name FROM nodes)
        SELECT n.id, n.label AS topic, string_agg(x.name, ',' ORDER BY t.src) AS via FROM nodes AS n JOIN hop USING (id) JOIN taken AS t ON t.dst = n.id AND relation = 'PUBLISHES' JOIN names AS x ON x.id = t.src WHERE kind = 'event_topic' GROUP BY n.id, n.label""",
    "gr09_consumes": f"""{_SERVICES}, names AS (SELECT id, label AS callback, {_NAME} AS consumer FROM nodes)
        SELECT n.id, n.label AS topic, consumer, callback FROM nodes AS n JOIN hop USING (id) JOIN taken AS t ON t.src = n.id AND relation = 'CONSUMED_BY' JOIN names AS x ON x.id = t.dst WHERE kind = 'event_topic'""",
    "gr10_endpoint_labels": f"{_services_only()} SELECT id, 'GET' AS method, substr(label, 5) AS path FROM nodes WHERE label LIKE 'GET /%'",
    "gr11_sequence": f"{_SEQUENCE} SELECT array_to_string(step, '.') AS step, src, dst, relation, certain, row_number() OVER (ORDER BY step) AS number FROM scope",
    "gr11_async_segments": f"""{_SEQUENCE}, queue AS (SELECT s.dst AS src, e.dst, min(s.step) AS first FROM scope AS s JOIN edges AS e ON e.src = s.dst AND e.relation = 'CONSUMED_BY' WHERE s.relation = 'PUBLISHES' GROUP BY s.dst, e.dst)
        SELECT src, dst, row_number() OVER (ORDER BY first, dst) AS segment, CAST(1 AS BIGINT) AS number FROM queue""",
    "agg01_evidence_union": """WITH f AS (SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY user_id, event_type)
        SELECT user_id, arg_min(event_type, seq) AS first_type, string_agg(event_type, ',' ORDER BY seq) AS evidence FROM f GROUP BY user_id""",
    "agg02_edge_upsert": """WITH d AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS seq FROM events GROUP BY ALL)
        SELECT user_id AS src, event_type AS dst, min(seq) AS first_event, string_agg(day, ',' ORDER BY seq) AS evidence FROM d GROUP BY user_id, event_type""",
    "agg03_summary": "SELECT lang AS kind, CAST(NULL AS VARCHAR) AS file, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT NULL, source, count(*) FROM documents GROUP BY source UNION ALL SELECT NULL, NULL, count(*) FROM documents",
    "agg05_legend": f"""{_services_only()} SELECT kind, count(*) AS n, CAST(CASE kind WHEN 'http_endpoint' THEN 1 WHEN 'database_table' THEN 2 WHEN 'event_topic' THEN 3 WHEN 'method' THEN 7 WHEN 'function' THEN 8 ELSE 9 END AS BIGINT) AS place FROM nodes GROUP BY kind""",
    "agg06_stats": f"{_SERVICES} SELECT (SELECT count(*) FROM hop) AS node_count, (SELECT count(*) FROM taken) AS edge_count, (SELECT CAST(max(abs(hop)) AS BIGINT) FROM hop) AS max_hop",
    "agg07_degrees": f"{_services_only()} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id",
    "win01_call_order": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS place FROM events",
    "win02_items": f"WITH RECURSIVE {with_clauses('services')}, {_ITEMS.format(CUSTOMER)} SELECT src, item, dst, relation, certain FROM items",
    "jn24_callers": f"WITH {with_clauses('transitions')} SELECT src, dst, relation, src AS label, 'src/' || src || '.ts' AS file FROM edges WHERE dst = '{EVENT}'",
    "jn24_callees": f"{_services_only()} SELECT e.src, e.dst, e.relation, n.label, n.kind, n.file FROM (SELECT * FROM edges WHERE src = '{CUSTOMER}' ORDER BY dst, relation LIMIT 50) AS e LEFT JOIN nodes AS n ON n.id = e.dst",
    "jn25_provenance": f"{_services_only()} SELECT coalesce(a.label, src) AS from_name, coalesce(b.label, dst) AS to_name, relation, certainty, CAST(NULL AS VARCHAR) AS derivation, edges.line IS NOT NULL AS proven, CAST(1 AS INT) AS confidence FROM edges LEFT JOIN nodes AS a ON a.id = src LEFT JOIN nodes AS b ON b.id = dst",
    "flt01_search": f"{_services_only()} SELECT id, label, file FROM nodes WHERE lower(label) LIKE '%handle1%' ORDER BY id LIMIT 30",
    "flt02_node": f"{_services_only()} SELECT id, label, kind, file FROM nodes WHERE id = '{CUSTOMER}'",
    "flt05_concern": f"""{_SERVICES}, w AS (SELECT * FROM taken WHERE relation = 'WRITES'), o AS (SELECT DISTINCT src AS id FROM w JOIN (SELECT DISTINCT dst AS x FROM taken WHERE src = '{CUSTOMER}') ON x = src)
        SELECT '{CUSTOMER}' AS id UNION SELECT id FROM o UNION SELECT dst FROM w JOIN o ON o.id = w.src""",
    "flt06_direction": f"{_SERVICES} SELECT id, hop FROM hop WHERE hop <= 0",
    "flt07_induced": f"{_SERVICES} SELECT src, dst, relation FROM taken WHERE dst NOT LIKE 'table:%'",
    "flt08_isolated": f"WITH {with_clauses('transitions')} SELECT src, dst, relation FROM edges WHERE (src, dst) IN (('view', 'click'), ('click', 'view'), ('click', 'purchase'), ('purchase', 'click'))",
    "flt09_helpers": f"""{_SERVICES}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM taken UNION ALL SELECT dst FROM taken) GROUP BY id)
        SELECT id, kind FROM hop JOIN nodes USING (id) LEFT JOIN d USING (id) WHERE id = '{CUSTOMER}' OR kind IN ('http_endpoint', 'database_table', 'event_topic') OR coalesce(n, 0) > 1""",
    "flt10_reprojected": f"{_EVENTS} SELECT direction, array_to_string(p, ' > ') AS path, count(*) AS n FROM (SELECT direction, list_filter(path, lambda x: x <> 'error') AS p FROM ends) WHERE len(p) > 1 GROUP BY direction, p",
    "srt02_symbols": f"{_services_only()} SELECT id, label, file FROM nodes ORDER BY label, coalesce(file, ''), id LIMIT 200",
    "srt05_best_path": f"{_EVENTS}, {_SCORED} SELECT direction, array_to_string(path, ' > ') AS path, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY score DESC, len(path) DESC, ord) AS r FROM scored) WHERE r = 1",
    "sc01_normalize": "SELECT page_id, 'x/' || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '/+', '/', 'g'), '/$', '') AS path FROM pages",
    "sc02_routes": """SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN '/r' || CAST(n_regionkey AS VARCHAR) ELSE '' END || '/' || CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE n_name END AS route FROM nation""",
    "sc03_table_tokens": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN regexp_extract(replace(n_name, ' ', '_'), '^[A-Za-z0-9_]+') END AS table_name FROM nation",
    "prj01_labels": f"""{_services_only()} SELECT id, {_NAME} AS name, CASE WHEN file IS NOT NULL THEN file || coalesce(':' || CAST(line AS VARCHAR), '') WHEN kind = 'event_topic' THEN 'topic' WHEN kind = 'database_table' THEN 'table' WHEN kind = 'http_endpoint' THEN 'endpoint' END AS place,
        array_to_string(list_slice(string_split(file, '/'), -2, -1), '/') AS tail FROM nodes""",
    "sc09_escaped": """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest,
        regexp_replace(regexp_replace(substr(text, 1, 60), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file FROM documents""",
    "gr12_columns": f"{_EVENTS}, {_RANKED}, d AS (SELECT direction, place, unnest(path) AS id, generate_subscripts(path, 1) - 1 AS i FROM ranked), s AS (SELECT id, CASE WHEN direction = 'upstream' THEN -i ELSE i END AS depth, direction, place FROM d) SELECT id, CAST(depth AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(depth) DESC, direction DESC, place) AS r FROM s) WHERE r = 1",
    "win07_column_ranks": f"""{_EVENTS}, {_RANKED}, d AS (SELECT direction, place, unnest(path) AS id, generate_subscripts(path, 1) - 1 AS i, len(path) - 1 AS final FROM ranked),
        c AS (SELECT id, CASE WHEN direction = 'upstream' THEN -i ELSE i END AS depth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC, direction DESC, place) AS r FROM d) WHERE r = 1),
        m AS (SELECT id, direction, place, CASE WHEN direction = 'upstream' THEN final - i ELSE i END AS spot FROM d),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY direction DESC, place, spot) AS r FROM m) WHERE r = 1)
        SELECT id, CAST(depth AS BIGINT) AS place, row_number() OVER (PARTITION BY depth ORDER BY direction DESC, f.place, spot, id) AS rank FROM c JOIN f USING (id)""",
    "gr13_best_through": f"{_EVENTS}, {_RANKED}, d AS (SELECT *, unnest(path) AS id FROM ranked) SELECT id, array_to_string(CASE WHEN direction = 'upstream' THEN list_reverse(path) ELSE path END, ' > ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC, direction DESC, place) AS r FROM d) WHERE r = 1",
    "gr14_highlighted": f"{_EVENTS}, h AS (SELECT path, unnest(range(1, len(path))) AS i FROM ends WHERE list_contains(path, 'purchase')) SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM h",
    "gr15_default_path": f"{_EVENTS}, {_RANKED} SELECT array_to_string(path, ' > ') AS path FROM ranked WHERE direction = 'downstream' AND place = 1",
    "gr16_edges_between": f"{_EVENTS}, h AS (SELECT path, unnest(range(1, len(path))) AS i FROM ends WHERE list_contains(path, 'purchase')), s AS (SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM h) SELECT src, dst, coalesce((SELECT min(relation) FROM edges AS e WHERE e.src = s.src AND e.dst = s.dst), 'calls') AS relation FROM s",
    "gr17_trace_steps": f"{_EVENTS}, {_RANKED} SELECT id, CAST(nullif(list_position(path, id), 0) AS BIGINT) AS step FROM nodes, (SELECT path FROM ranked WHERE direction = 'downstream' AND place = 1)",
    "gr18_message_rows": f"""WITH RECURSIVE {with_clauses('services')}, {_ITEMS.format(CUSTOMER).replace('depth < 4', 'depth < 2')}, q AS (SELECT DISTINCT e.src, e.dst FROM scope AS s JOIN edges AS e ON e.src = s.dst AND e.relation = 'CONSUMED_BY' WHERE s.relation = 'PUBLISHES'),
        c AS (SELECT (SELECT count(*) FROM scope) AS a, (SELECT count(*) FROM q) AS b) SELECT a + b AS n, a + 2 * b AS last, a + b AS n_rows FROM c""",
    "win06_lanes": f"WITH {with_clauses('transitions')} SELECT src, dst, relation, row_number() OVER (PARTITION BY src ORDER BY length(dst), dst, relation) - 1 AS lane FROM edges",
    "jn26_topic_flows": f"{_services_only()} SELECT a.dst AS topic, b.dst AS consumer, count(*) AS n FROM edges AS a JOIN edges AS b ON a.dst = b.src WHERE a.relation = 'PUBLISHES' AND b.relation = 'CONSUMED_BY' GROUP BY a.dst, b.dst",
    "flt03_noise": f"""{_services_only()} SELECT id, false AS noise, CASE WHEN file IS NULL THEN 'symbol' ELSE 'module' END AS guess FROM nodes""",
    "prj03_urls": f"{_services_only()} SELECT id, 'vscode://file//work/tree/' || file || coalesce(':' || CAST(line AS VARCHAR), '') AS url, '#' || lpad(lower(to_hex(line)), 6, '0') AS colour FROM nodes",
    "prj04_hops": f"{_SERVICES} SELECT id, CASE WHEN hop = 0 THEN '0 (target)' WHEN hop > 0 THEN '+' || CAST(hop AS VARCHAR) ELSE CAST(hop AS VARCHAR) END AS hop FROM hop",
    "sc07_uri": "SELECT doc_id, md5(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')) AS digest, url_decode(url_encode(text)) = text AS same FROM documents",
    "srt01_node_order": """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '_' || c_mktsegment ELSE c_mktsegment END || '#' || c_custkey AS name FROM customer)
        SELECT c_custkey, name, row_number() OVER (ORDER BY icu_sort_key(name, 'und')) AS place FROM c""",
    "srt03_node_list": f"{_SERVICES} SELECT id, row_number() OVER (ORDER BY hop, icu_sort_key(label, 'und'), id) AS place FROM hop JOIN nodes USING (id)",
    "srt10_edge_list": f"{_SERVICES} SELECT src, dst, relation, row_number() OVER (ORDER BY icu_sort_key(label, 'und'), src, dst, relation) AS place FROM taken JOIN nodes ON id = src",
    "gr18_step_texts": f"{_SEQUENCE} SELECT src, dst, relation, CASE WHEN certain THEN '' ELSE '~' END || array_to_string(step, '.') AS step FROM scope",
} | SOURCE_SQL

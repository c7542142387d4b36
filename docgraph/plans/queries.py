"""One query for each operator over the star tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Property, SourceConfig, Walk
from ..functions import codecs, scalars
from ..model import IN, OUT, as_documents, key, key_text, no_props
from ..operators import delta, dirty, graph, recompute, resolve, walk
from ..operators import reduce as red
from ..operators import requests as req
from ..operators.extract import Custom, Reference, References, extract, merged_props, oriented, self_loops, without_rejected
from ..sources import changes, fixtures
from ..sources.documents import scan, table, table_documents
from ..storage import checkpointed
from ..streaming.updater import backoff, split_dead
from . import catalog as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(key_text("tail").alias("tail"), "label", key_text("head").alias("head"))


ORDER_EDGES = "SELECT 'shop/orders/' || o_orderkey AS tail, 'placed_by' AS label, 'shop/customer/' || o_custkey AS head FROM orders"
STAR_EDGES = f"""{ORDER_EDGES}
UNION ALL SELECT 'shop/customer/' || c_custkey, 'lives_in', 'shop/nation/' || c_nationkey FROM customer
UNION ALL SELECT 'shop/nation/' || n_nationkey, 'part_of', 'shop/region/' || n_regionkey FROM nation"""
HREFS = "SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages"

# --- scans and lookups


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'MISSING' WHEN o_orderkey % 2 = 0 THEN 'EXPIRED' ELSE 'OK' END AS status FROM orders
""")
def doc_get_versioned(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    id_ = F.when(o["o_orderkey"] % 10 == 0, F.concat(F.lit("none-"), o["o_custkey"])).otherwise(o["o_custkey"].cast("string"))
    asked = o.select("o_orderkey", key("shop", "customer", id_).alias("key"), (2 - o["o_orderkey"] % 2).alias("version"))
    return resolve.get_versioned(asked, table_documents(spark, sf, "customer")).select("o_orderkey", "status")


@query("""
SELECT 'shop/customer/' || c_custkey AS key, 1::BIGINT AS version FROM customer UNION ALL SELECT 'shop/nation/' || n_nationkey, 1 FROM nation
""")
def scan_index_type(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "customer", "nation", "orders")
    parts = c.keys_of(docs)
    return scan(parts, ["shop"], "customer").unionByName(scan(parts, ["shop"], "nation")).select(key_text("key").alias("key"), "version")


def star_vertices(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    return graph.vertices(c.keys_of(docs), edges)


@query("""
SELECT 'shop/orders/' || o_orderkey AS key, 1::BIGINT AS version FROM orders UNION ALL SELECT 'shop/customer/' || c_custkey, 1 FROM customer
UNION ALL SELECT 'shop/nation/' || n_nationkey, 1 FROM nation UNION ALL SELECT 'shop/region/' || r_regionkey, 1 FROM region
""")
def graph_vertices_in_index(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_index(star_vertices(spark, sf), "shop").select(key_text("key").alias("key"), "version")


@query("SELECT 'shop/nation/' || n_nationkey AS key, 1::BIGINT AS version FROM nation")
def graph_vertices_in_type(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_type(star_vertices(spark, sf), "shop", "nation").select(key_text("key").alias("key"), "version")


@query("SELECT 'shop/customer/' || c_custkey AS key, 1::BIGINT AS version FROM customer WHERE c_custkey = 7")
def graph_vertex_exact(spark: SparkSession, sf: str) -> DataFrame:
    v = star_vertices(spark, sf)
    found = graph.resolve(v, "shop", "customer", "7", 1).unionByName(graph.resolve(v, "shop", "customer", "8", 2))
    return found.select(key_text("key").alias("key"), "version")


@query("SELECT 'shop/customer/' || c_custkey AS key, 1::BIGINT AS version FROM customer WHERE c_custkey = 8")
def graph_vertex_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolve(star_vertices(spark, sf), "shop", "customer", "8").select(key_text("key").alias("key"), "version")


@query("SELECT 'shop/customer/' || o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def graph_vertex_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ends of all orders' edges, which no graph has merged yet."""
    ends = c.edges_of(c.documents(spark, sf, "orders")).select(F.col("head").alias("key"))
    return graph.duplicates(ends).select(key_text("key").alias("key"), F.col("count").alias("n"))


@query(f"SELECT * FROM ({ORDER_EDGES}) WHERE tail = 'shop/orders/5'")
def graph_edge_find(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "orders").where("o_orderkey = 5").first()
    head = customer["o_custkey"] if customer else None
    return edge_rows(graph.find_edges(c.star(spark, sf)[1], key("shop", "orders", F.lit("5")), "placed_by", key("shop", "customer", F.lit(head))))


@query(STAR_EDGES)
def graph_owned_edges(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    return edge_rows(graph.owned_by(edges, c.keys_of(docs)))


@query(f"""
WITH e AS ({STAR_EDGES}) SELECT head AS key, 'IN' AS direction, label, tail AS other FROM e WHERE head LIKE 'shop/nation/%'
UNION ALL SELECT tail, 'OUT', label, head FROM e WHERE tail LIKE 'shop/nation/%'
""")
def graph_incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    parts = [graph.incident(edges, docs["nation"], d).select(key_text("key").alias("key"), F.lit(d).alias("direction"), "label", key_text("other").alias("other")) for d in (IN, OUT)]
    return parts[0].unionByName(parts[1])


@query(STAR_EDGES)
def graph_edge_dump(spark: SparkSession, sf: str) -> DataFrame:
    return edge_rows(c.star(spark, sf)[1])


@query("""
SELECT key, neighbour FROM (SELECT 'shop/customer/' || c_custkey AS key, 'shop/nation/' || c_nationkey AS neighbour FROM customer
UNION ALL SELECT 'shop/nation/' || c_nationkey, 'shop/customer/' || c_custkey FROM customer)
""")
def graph_opposite(spark: SparkSession, sf: str) -> DataFrame:
    edges = c.edges_of(c.documents(spark, sf, "customer"))
    ends = edges.withColumn("me", F.explode(F.array("tail", "head")))
    return ends.select(key_text("me").alias("key"), key_text(graph.opposite(F.col("tail"), F.col("head"), F.col("me"))).alias("neighbour"))


# --- extraction


@query(ORDER_EDGES)
def extract_fk(spark: SparkSession, sf: str) -> DataFrame:
    return edge_rows(extract(table_documents(spark, sf, "orders"), c.RULES["orders"]))


@query("SELECT 'shop/customer/' || o_custkey AS tail, 'placed' AS label, 'shop/orders/' || o_orderkey AS head, 'shop/orders/' || o_orderkey AS owner FROM orders")
def extract_inwards(spark: SparkSession, sf: str) -> DataFrame:
    rule = Reference("placed", "shop", "customer", lambda d: d["o_custkey"], inwards=True)
    edges = extract(table_documents(spark, sf, "orders"), (rule,))
    return edges.select(key_text("tail").alias("tail"), "label", key_text("head").alias("head"), key_text("owner").alias("owner"))


@query("""
SELECT 'shop/orders/' || l_orderkey AS tail, 'contains' AS label, 'shop/part/' || l_partkey AS head FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
""")
def extract_array(spark: SparkSession, sf: str) -> DataFrame:
    carts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    docs = as_documents(carts, "shop", "orders", "l_orderkey")
    return edge_rows(extract(docs, (References("contains", "shop", "part", lambda d: d["parts"]),)))


@query(f"SELECT 'web/pages/' || url AS tail, 'links_to' AS label, 'web/pages/' || href AS head FROM ({HREFS})")
def extract_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return edge_rows(c.page_edges(spark, sf))


@query("SELECT 'shop/supplier/' || s_suppkey AS tail, 'rich_in' AS label, 'shop/nation/' || s_nationkey AS head FROM supplier WHERE s_acctbal > 5000")
def extract_custom(spark: SparkSession, sf: str) -> DataFrame:
    def rich(docs: DataFrame) -> DataFrame:
        d = F.col("doc")
        return docs.where(d["s_acctbal"] > 5000).select("key", key("shop", "nation", d["s_nationkey"]).alias("other"), F.lit("rich_in").alias("label"), F.lit(False).alias("inwards"), no_props().alias("props"))

    return edge_rows(extract(table_documents(spark, sf, "supplier"), (Custom(rich),)))


@query(f"""
{ORDER_EDGES} UNION ALL SELECT 'shop/day/' || strftime(o_orderdate, '%Y-%m-%d'), 'saw', 'shop/orders/' || o_orderkey FROM orders
""")
def extract_merge_configs(spark: SparkSession, sf: str) -> DataFrame:
    rules = (*c.RULES["orders"], Reference("saw", "shop", "day", lambda d: F.date_format(d["o_orderdate"], "yyyy-MM-dd"), inwards=True))
    return edge_rows(extract(table_documents(spark, sf, "orders"), rules))


@query("""
SELECT c_custkey, 'b' AS type, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer
""")
def extract_merge_props(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer")
    first = F.create_map(F.lit("type"), F.lit("a"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    second = F.create_map(F.lit("type"), F.lit("b"), F.lit("segment"), F.col("c_mktsegment"))
    p = merged_props([first, second])
    return t.select("c_custkey", p["type"].alias("type"), p["nation"].alias("nation"), p["segment"].alias("segment"))


TRANSITIONS = "SELECT DISTINCT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events"


@query(f"SELECT 'log/type/' || a AS key FROM ({TRANSITIONS}) WHERE a = b")
def extract_self_loops(spark: SparkSession, sf: str) -> DataFrame:
    return self_loops(c.transitions(spark, sf)).select(key_text("tail").alias("key"))


@query("""
SELECT 'shop/customer/' || c_custkey AS tail, unnest(['lives_in', 'brought_by']) AS label, unnest(['shop/nation/' || c_nationkey, 'shop/customer/' || c_nationkey]) AS head
FROM customer WHERE c_custkey <> c_nationkey
""")
def extract_rejects_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that refer to the customer with their nation's number; those who are that customer lose all their edges."""
    brought = Reference("brought_by", "shop", "customer", lambda d: d["c_nationkey"])
    return edge_rows(without_rejected(extract(table_documents(spark, sf, "customer"), (*c.RULES["customer"], brought))))


# --- the graph under commits and deletes


@query(f"SELECT 'web/pages/' || href AS key FROM (SELECT DISTINCT href FROM ({HREFS})) WHERE href NOT IN (SELECT url FROM pages)")
def graph_symbolic(spark: SparkSession, sf: str) -> DataFrame:
    v = graph.vertices(c.pages(spark, sf), c.page_edges(spark, sf))
    return graph.symbolic(v).select(key_text("key").alias("key"))


@query(f"""
SELECT tail, label, head, n AS owners FROM (SELECT 'log/type/' || least(a, b) AS tail, 'near' AS label, 'log/type/' || greatest(a, b) AS head, count(DISTINCT a) AS n
FROM ({TRANSITIONS}) WHERE a <> b GROUP BY ALL) WHERE n > 1
""")
def graph_owner_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    t = c.transitions(spark, sf).where(F.col("tail") != F.col("head"))
    first, second = F.least(F.col("tail")["id"], F.col("head")["id"]), F.greatest(F.col("tail")["id"], F.col("head")["id"])
    undirected = t.select(key("log", "type", first).alias("tail"), F.lit("near").alias("label"), key("log", "type", second).alias("head"), "owner", "props")
    return graph.owner_conflicts(undirected).select(key_text("tail").alias("tail"), "label", key_text("head").alias("head"), "owners")


def changed_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """The order graph and a batch: orders divisible by 7 come in version 2 and refer to customer 1; those divisible by 11 in version 0."""
    docs = c.documents(spark, sf, "orders", "customer")
    committed, edges = c.keys_of(docs), c.edges_of({"orders": docs["orders"]})
    n = F.col("doc")["o_orderkey"]
    batch = docs["orders"].where((n % 7 == 0) | (n % 11 == 0)).withColumn("version", F.when(n % 7 == 0, 2).otherwise(0).cast("long"))
    moved = Reference("placed_by", "shop", "customer", lambda d: F.when(d["o_orderkey"] % 2 == 0, F.lit("1")).otherwise(F.lit("new")))
    return committed, edges, batch.select("key", "version"), extract(batch, (moved,))


MOVED = "CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'new' END ELSE o_custkey::VARCHAR END"


@query(f"SELECT 'shop/orders/' || o_orderkey AS tail, 'placed_by' AS label, 'shop/customer/' || {MOVED} AS head FROM orders")
def graph_commit_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = graph.commit(*changed_orders(spark, sf))
    return edge_rows(edges)


@query("SELECT 'shop/orders/' || o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM orders UNION ALL SELECT 'shop/customer/' || c_custkey, 1 FROM customer")
def graph_commit_claim(spark: SparkSession, sf: str) -> DataFrame:
    now, _, _ = graph.commit(*changed_orders(spark, sf))
    return now.select(key_text("key").alias("key"), "version")


@query("""
SELECT 'shop/orders/' || o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM orders UNION ALL SELECT 'shop/customer/' || c_custkey, 1 FROM customer
UNION ALL SELECT 'shop/customer/new', 0 WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 14 = 7)
""")
def graph_commit_gc(spark: SparkSession, sf: str) -> DataFrame:
    now, edges, _ = graph.commit(*changed_orders(spark, sf))
    return graph.vertices(now, edges).select(key_text("key").alias("key"), "version")


@query("SELECT 'shop/orders/' || o_orderkey AS key, 0::BIGINT AS version FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0")
def commit_version_guard(spark: SparkSession, sf: str) -> DataFrame:
    _, _, rejected = graph.commit(*changed_orders(spark, sf))
    return rejected.select(key_text("key").alias("key"), "version")


def deleted_customers(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Orders and customers; every tenth customer is deleted. Before and after: vertices; edges; the deleted keys."""
    docs = c.documents(spark, sf, "orders", "customer")
    committed, edges = c.keys_of(docs), c.edges_of(docs)
    gone = docs["customer"].where(F.col("doc")["c_custkey"] % 10 == 0).select("key")
    now, left = graph.delete(committed, edges, gone)
    return graph.vertices(committed, edges), graph.vertices(now, left), edges, left, gone


@query("""
WITH gone AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 10 = 0)
SELECT 'shop/customer/' || c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS version FROM customer
WHERE c_custkey % 10 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders)
""")
def graph_delete_doc(spark: SparkSession, sf: str) -> DataFrame:
    after = deleted_customers(spark, sf)[1]
    return graph.in_type(after, "shop", "customer").select(key_text("key").alias("key"), "version")


@query("""
SELECT 'shop/customer/' || c_custkey AS key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'symbolic' ELSE 'gone' END AS fate FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 'shop/nation/' || c_nationkey, 'gone' FROM customer GROUP BY c_nationkey HAVING bool_and(c_custkey % 10 = 0)
""")
def graph_delete_affected(spark: SparkSession, sf: str) -> DataFrame:
    before, after, *_ = deleted_customers(spark, sf)
    return graph.affected_by_delete(before, after).select(key_text("key").alias("key"), "fate")


@query("""
SELECT c_custkey, '"' || c_name || '"' AS name, c_nationkey::VARCHAR AS nation, '[' || c_custkey || ',' || c_nationkey || ']' AS pair, true AS valid FROM customer
""")
def graph_props(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.extract import valid_props

    t = table(spark, sf, "customer")
    p = codecs.encoded_props({"name": F.col("c_name"), "nation": F.col("c_nationkey"), "pair": F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long"))})
    return t.select("c_custkey", p.alias("p")).select("c_custkey", F.col("p")["name"].alias("name"), F.col("p")["nation"].alias("nation"), F.col("p")["pair"].alias("pair"), valid_props(F.col("p")).alias("valid"))


@query("""
SELECT c_custkey, '["shop","customer","' || c_custkey || '",1]' AS id, c_custkey::VARCHAR AS back,
'{"tail":{"index":"shop","type":"customer","id":"' || c_custkey || '"},"label":"lives_in","head":{"index":"shop","type":"nation","id":"' || c_nationkey || '"}}' AS edge FROM customer
""")
def id_codec(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer")
    k, n = key("shop", "customer", "c_custkey"), key("shop", "nation", "c_nationkey")
    made = codecs.id_json(k, F.lit(1))
    return t.select("c_custkey", made.alias("id"), codecs.id_from_json(made)["id"].alias("back"), codecs.edge_json(k, F.lit("lives_in"), n).alias("edge"))


@query("""
SELECT 1 AS request, 'DELETE' AS action, 'shop/nation/' || n_nationkey AS key, 1::BIGINT AS version FROM nation
UNION ALL SELECT 2, 'UPDATE', 'shop/customer/3', 1 UNION ALL SELECT 3, 'UPDATE', 'shop/customer/4', 9
""")
def scope_fanout(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "DELETE", "shop", "nation", None, None), (2, "UPDATE", "shop", "customer", "3", None), (3, "UPDATE", "shop", "customer", "4", 9)]
    wanted = spark.createDataFrame(rows, "request int, action string, index string, type string, id string, version long")
    return dirty.fan_out(wanted, star_vertices(spark, sf)).select("request", "action", key_text("key").alias("key"), "version")


# --- walks

UP = """
SELECT 'shop/orders/' || o_orderkey AS root, unnest(['shop/orders/' || o_orderkey, 'shop/customer/' || o_custkey, 'shop/nation/' || c_nationkey, 'shop/region/' || n_regionkey]) AS node,
unnest([0, 1, 2, 3]) AS depth FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def reach_rows(reached: DataFrame) -> DataFrame:
    return reached.select(key_text("root").alias("root"), key_text("node").alias("node"), "depth")


@query(UP)
def walk_chain(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    return reach_rows(walk.chain(edges, docs["orders"], OUT, 3))


TURN_WALK = """
SELECT 'chat/turn/' || a.conv_id || '-' || a.turn AS root, 'chat/turn/' || b.conv_id || '-' || b.turn AS node, abs(a.turn - b.turn)::INT AS depth
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn {} a.turn
"""


@query(TURN_WALK.format("<="))
def walk_reach_out(spark: SparkSession, sf: str) -> DataFrame:
    return reach_rows(walk.reach(c.turn_edges(spark, sf), c.turns(spark, sf), OUT))


@query(TURN_WALK.format(">=") + " WHERE a.turn = 0")
def walk_reach_in(spark: SparkSession, sf: str) -> DataFrame:
    return reach_rows(walk.reach(c.turn_edges(spark, sf), c.turns(spark, sf).where(F.col("doc")["turn"] == 0), IN))


@query(TURN_WALK.format("<"))
def walk_closure(spark: SparkSession, sf: str) -> DataFrame:
    return reach_rows(walk.closure(c.turn_edges(spark, sf), OUT))


@query(TURN_WALK.format("<=") + " WHERE a.turn - b.turn <= 2")
def walk_depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    return reach_rows(walk.reach(c.turn_edges(spark, sf), c.turns(spark, sf), OUT, max_depth=2))


@query(f"""
WITH RECURSIVE t AS ({TRANSITIONS}), e AS (SELECT a, b FROM t WHERE a <> b), r AS (SELECT a AS root, a AS node FROM e UNION SELECT root, b FROM r JOIN e ON node = a)
SELECT 'log/type/' || root AS root, 'log/type/' || node AS node FROM r
""")
def walk_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    edges = c.transitions(spark, sf).where(F.col("tail") != F.col("head"))
    return reach_rows(walk.reach(edges, edges.select(F.col("tail").alias("key")), OUT)).drop("depth")


@query("""
SELECT 'chat/turn/' || a.conv_id || '-' || a.turn AS root, 'chat/turn/' || a.conv_id || '-0' AS node FROM conversations a
""")
def walk_leaves(spark: SparkSession, sf: str) -> DataFrame:
    edges = c.turn_edges(spark, sf)
    reached = walk.reach(edges, c.turns(spark, sf), OUT)
    return reach_rows(walk.leaves(reached, edges, OUT)).drop("depth")


@query("""
SELECT 'chat/turn/' || a.conv_id || '-' || a.turn AS root, 'chat/turn/' || b.conv_id || '-' || b.turn AS node, (b.turn - a.turn)::INT AS position
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn WHERE a.turn = 0
""")
def walk_flatten(spark: SparkSession, sf: str) -> DataFrame:
    edges = c.turn_edges(spark, sf)
    reached = walk.reach(edges, c.turns(spark, sf).where(F.col("doc")["turn"] == 0), IN)
    flat = walk.flattened(walk.tree(reached, edges, IN))
    return flat.select(key_text("root").alias("root"), key_text("node").alias("node"), "position")


@query("""
SELECT 'chat/turn/' || a.conv_id || '-0' AS root, (b.turn)::INT AS seq, repeat('  ', b.turn::INT) || 'chat/turn/' || b.conv_id || '-' || b.turn AS line
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0
""")
def walk_pretty(spark: SparkSession, sf: str) -> DataFrame:
    edges = c.turn_edges(spark, sf)
    reached = walk.reach(edges, c.turns(spark, sf).where(F.col("doc")["turn"] == 0), IN)
    return walk.pretty(walk.tree(reached, edges, IN)).select(key_text("root").alias("root"), "seq", "line")


@query(f"""
SELECT 'web/pages/' || url AS root, count(*) AS nodes, count(*) FILTER (WHERE href IN (SELECT url FROM pages)) AS existing FROM ({HREFS}) GROUP BY url
""")
def walk_fetch_exists(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.pages(spark, sf)
    reached = walk.chain(c.page_edges(spark, sf), docs, OUT, 1).where("depth = 1")
    found = resolve.resolve(reached, docs)
    return found.groupBy("root").agg(F.count("*").alias("nodes"), F.count_if("exists").alias("existing")).select(key_text("root").alias("root"), "nodes", "existing")


@query("""
SELECT 'shop/orders/' || o_orderkey AS root FROM orders WHERE o_custkey % 10 = 0
""")
def walk_expired(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    store = c.documents(spark, sf, "customer")["customer"].withColumn("version", F.when(F.col("doc")["c_custkey"] % 10 == 0, 2).otherwise(1).cast("long"))
    reached = walk.chain(edges, docs["orders"], OUT, 1)
    return resolve.expired_roots(resolve.resolve(reached, store, graph.vertices(c.keys_of(docs), edges))).select(key_text("root").alias("root"))


TREE_EDGE = """{{"edge": {{"from": ["shop", "{}", "' || {} || '"], "label": "{}"}}, """
TREE_NODE = """"exists": true, "value": {{"name": "' || {} || '"}}, "vertex": ["shop", "{}", "' || {} || '"]}}}}"""


@query(f"""
WITH s AS (SELECT s_nationkey AS up, s_suppkey::VARCHAR AS id, '{{"_children": [], "_value": {TREE_EDGE.format("nation", "s_nationkey", "lives_in")}{TREE_NODE.format("s_name", "supplier", "s_suppkey")}' AS j FROM supplier),
n AS (SELECT n_regionkey AS up, n_nationkey::VARCHAR AS id, '{{"_children": [' || coalesce((SELECT string_agg(j, ', ' ORDER BY s.id) FROM s WHERE s.up = n_nationkey), '') || '], "_value": {TREE_EDGE.format("region", "n_regionkey", "part_of")}{TREE_NODE.format("n_name", "nation", "n_nationkey")}' AS j FROM nation)
SELECT 'shop/region/' || r_regionkey AS root, '{{"_children": [' || coalesce((SELECT string_agg(j, ', ' ORDER BY n.id) FROM n WHERE n.up = r_regionkey), '') || '], "_value": {{{TREE_NODE.format("r_name", "region", "r_regionkey")}' AS value FROM region
""")
def walk_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions with the whole tree below them as JSON: nations, then suppliers."""
    docs = c.documents(spark, sf, "supplier", "nation", "region")
    edges = c.edges_of(docs)
    reached = walk.reach(edges, docs["region"], IN)
    named = lambda n: docs[n].select("key", F.struct(F.col("doc")[f"{n[0]}_name"].alias("name")).alias("doc"))
    store = named("region").unionByName(named("nation")).unionByName(named("supplier"))
    return red.by_tree(walk.tree(reached, edges, IN), store, lambda t: t).select(key_text("root").alias("root"), "value")


# --- predicates and operations on trees that stand by themselves


@query("""
SELECT o_orderkey, c_name AS name, CASE WHEN c_custkey IS NULL THEN NULL ELSE 1 END::BIGINT AS stored, c_custkey IS NOT NULL AS found
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 10 <> 0
""")
def doc_get_any_version(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    id_ = F.when(o["o_orderkey"] % 10 == 0, F.concat(F.lit("none-"), o["o_custkey"])).otherwise(o["o_custkey"].cast("string"))
    found = resolve.get(o.select("o_orderkey", key("shop", "customer", id_).alias("key")), table_documents(spark, sf, "customer"))
    return found.select("o_orderkey", F.col("doc")["c_name"].alias("name"), "stored", "found")


@query("""
SELECT 'shop/customer/' || o_custkey AS vertex, 'shop/orders/' || o_orderkey AS me, o_orderkey % 4 < 2 OR o_orderkey = first OR o_custkey % 5 = 0 AS ownable
FROM orders JOIN (SELECT o_custkey AS c, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) ON o_custkey = c
""")
def graph_ownable(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an order may take its customer's vertex: half of the time nobody has it, otherwise the customer's first order; a fifth of the vertices is symbolic."""
    o = table(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    me = key("shop", "orders", "o_orderkey")
    owner = F.when(F.col("o_orderkey") % 4 >= 2, key("shop", "orders", "first"))
    version = F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(3)
    return o.join(first, "o_custkey").select(key_text(key("shop", "customer", "o_custkey")).alias("vertex"), key_text(me).alias("me"), graph.ownable(owner, version, me).alias("ownable"))


@query("""
WITH s AS (SELECT * FROM (VALUES ('INDEX', 1), ('TYPE_IN_INDEX', 2), ('DOCUMENT_ANY_VERSION', 3), ('DOCUMENT', 4)) t(name, n))
SELECT a.name AS scope, b.name AS of, b.n <= a.n AS contained FROM s a, s b
""")
def scope_containment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a in req.SCOPES for b in req.SCOPES], "scope string, of string")
    return pairs.withColumn("contained", req.in_scope(F.col("scope"), F.col("of")))


@query("""
SELECT user_id, event_type, min(position) AS position FROM
(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events) GROUP BY user_id, event_type
""")
def walk_first_visits(spark: SparkSession, sf: str) -> DataFrame:
    seen = c.change_log(spark, sf).select(F.col("key")["id"].cast("long").alias("user_id"), "event_type", F.col("version").alias("position"))
    return walk.first_visits(seen, ["user_id", "event_type"], "position")


@query("SELECT o_orderkey, coalesce(o_totalprice > 200000, false) OR o_custkey % 7 = 0 OR o_orderkey < 10 AS stop FROM orders")
def walk_stops(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", walk.any_stop(F.col("o_totalprice") > 200000, F.col("o_custkey") % 7 == 0, F.col("o_orderkey") < 10).alias("stop"))


@query("""
SELECT 'shop/orders/' || o_orderkey AS root, 'shop/nation/' || c_nationkey AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = o_orderkey % 25
""")
def walk_in_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose upward walk meets the nation that the order's number names."""
    docs, edges = c.star(spark, sf)
    wanted = docs["orders"].select(F.col("key").alias("root"), key("shop", "nation", F.col("doc")["o_orderkey"] % 25).alias("node"))
    return walk.in_tree(walk.chain(edges, docs["orders"], OUT, 2), wanted).select(key_text("root").alias("root"), key_text("node").alias("node"))


@query("""
SELECT 'shop/region/' || r_regionkey AS root, 'shop/region/' || r_regionkey AS node, NULL::VARCHAR AS parent, 0::INT AS depth, lower(r_name) AS value FROM region
UNION ALL SELECT 'shop/region/' || n_regionkey, 'shop/nation/' || n_nationkey, 'shop/region/' || n_regionkey, 1, lower(n_name) FROM nation
UNION ALL SELECT 'shop/region/' || n_regionkey, 'shop/supplier/' || s_suppkey, 'shop/nation/' || n_nationkey, 2, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def walk_map_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Trees below the regions, of the same shape, with names in small letters; suppliers have no document here."""
    docs = c.documents(spark, sf, "supplier", "nation", "region")
    edges = c.edges_of(docs)
    store = docs["region"].select("key", F.struct(F.col("doc")["r_name"].alias("name")).alias("doc")).unionByName(docs["nation"].select("key", F.struct(F.col("doc")["n_name"].alias("name")).alias("doc")))
    made = walk.map_tree(walk.tree(walk.reach(edges, docs["region"], IN), edges, IN), store, F.lower(F.col("doc")["name"]))
    return made.select(key_text("root").alias("root"), key_text("node").alias("node"), F.when(F.col("parent").isNotNull(), key_text("parent")).alias("parent"), "depth", "value")


# --- reductions


@query("SELECT 'shop/customer/' || c_custkey AS key, count(o_orderkey) AS in_degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def reduce_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "orders", "customer")
    return red.in_degree(c.edges_of({"orders": docs["orders"]}), docs["customer"]).select(key_text("key").alias("key"), "in_degree")


def nation_walk(spark: SparkSession, sf: str, *properties: Property, where: Callable | None = None) -> DataFrame:
    """Nations with properties of the orders of their customers: two steps in."""
    docs, edges = c.star(spark, sf)
    w = Walk("orders", IN, properties, depth=2, where=where or (lambda k, d: F.col("depth") == 2))
    values, _ = recompute.walk_values(docs["orders"], edges, docs["nation"], w)
    return values.withColumn("root", key_text("root"))


NATION = "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey"


@query(f"SELECT 'shop/nation/' || n_nationkey AS root, count(o_orderkey) AS n_orders {NATION}")
def reduce_count(spark: SparkSession, sf: str) -> DataFrame:
    return nation_walk(spark, sf, Property("n_orders", lambda d: F.count("*"), empty=0))


@query(f"SELECT 'shop/nation/' || n_nationkey AS root, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total {NATION}")
def reduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return nation_walk(spark, sf, Property("total", lambda d: F.sum(d["o_totalprice"].cast("decimal(18,2)")).cast("double")))


@query(f"SELECT 'shop/nation/' || n_nationkey AS root, min(o_totalprice) AS least, max(o_totalprice) AS most {NATION}")
def reduce_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return nation_walk(spark, sf, Property("least", lambda d: F.min(d["o_totalprice"])), Property("most", lambda d: F.max(d["o_totalprice"])))


@query(f"SELECT 'shop/nation/' || n_nationkey AS root, count(DISTINCT o_orderpriority) AS priorities {NATION}")
def reduce_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return nation_walk(spark, sf, Property("priorities", lambda d: F.countDistinct(d["o_orderpriority"]), empty=0))


@query("""
SELECT 'shop/customer/' || c_custkey AS root, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), ',') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def reduce_collect(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "orders", "customer")
    w = Walk("orders", IN, (Property("orders", lambda d: F.array_join(red.collected(d["o_orderkey"]), ",")),), depth=1)
    values, _ = recompute.walk_values(docs["orders"], c.edges_of({"orders": docs["orders"]}), docs["customer"], w)
    return values.withColumn("root", key_text("root"))


@query("SELECT 'shop/region/' || r_regionkey AS root, count(n_nationkey)::BIGINT AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def reduce_child_count(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "nation", "region")
    edges = c.edges_of(docs)
    shaped = walk.tree(walk.reach(edges, docs["region"], IN), edges, IN)
    made = red.by_tree(shaped, docs["nation"].select("key", F.struct("key").alias("doc")), lambda t: len(t["_children"]))
    return made.select(key_text("root").alias("root"), F.col("value").cast("long").alias("children"))


@query("SELECT 'shop/nation/' || n_nationkey AS root, array_to_string(list_sort(list(c_name) FILTER (c_name IS NOT NULL)), ',') AS names FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def reduce_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "customer", "nation")
    edges = c.edges_of({"customer": docs["customer"]})
    names = lambda t: ",".join(sorted(n["_value"]["value"]["name"] for n in red.nodes(t)[1:]))
    store = docs["customer"].select("key", F.struct(F.col("doc")["c_name"].alias("name")).alias("doc"))
    made = red.by_tree(walk.tree(walk.chain(edges, docs["nation"], IN, 1), edges, IN), store, names)
    return made.select(key_text("root").alias("root"), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("names")).withColumn("names", F.when(F.col("names") != "", F.col("names")))


# --- filters, transformation, recomputation


@query("""
SELECT event_id, value IS NOT NULL AND value <> 0 AS by_value, event_type <> '' AS by_text, try_cast(json_extract_string(props, '$.k') AS INT) <> 0 AS by_json FROM events
""")
def filter_truthy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", recompute.truthy(F.col("value"), "double").alias("by_value"), recompute.truthy(F.col("event_type"), "string").alias("by_text"), recompute.truthy(k, "int").alias("by_json"))


RICH = SourceConfig("rich", "customer", "shop", "customer", extract=c.RULES["customer"], filter=lambda d: d["c_acctbal"] > 0)


@query("SELECT c_custkey, c_acctbal > 0 AS written, 1::BIGINT AS edges FROM customer")
def filter_keeps_edges(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_documents(spark, sf, "customer")
    edges = extract(docs, RICH.extract)
    made = recompute.recompute(docs, edges, RICH).select(F.col("from_source")["key"].alias("owner"), (F.col("status") == "OK").alias("written"))
    n = edges.groupBy("owner").agg(F.count("*").alias("edges"))
    return made.join(n, "owner").select(F.col("owner")["id"].cast("long").alias("c_custkey"), "written", "edges")


@query("SELECT 'target/customer/' || c_custkey AS key, upper(c_name) AS name, c_acctbal * 2 AS double FROM customer")
def transform_project(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_documents(spark, sf, "customer")
    cfg = SourceConfig("target", "customer", "shop", "customer", transform=lambda d: F.struct(F.upper(d["c_name"]).alias("name"), (d["c_acctbal"] * 2).alias("double")))
    return recompute.recompute(docs, c.edges_of({"customer": docs}), cfg).select(key_text("key").alias("key"), "doc.name", "doc.double")


@query("""
SELECT c_custkey, coalesce(n, 0) AS c_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
""")
def merge_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "orders", "customer")
    w = Walk("orders", IN, (Property("c_name", lambda d: F.count("*"), empty=0),), depth=1)
    cfg = SourceConfig("enriched", "customer", "shop", "customer", walks=(w,))
    return recompute.recompute(c.together(docs), c.edges_of({"orders": docs["orders"]}), cfg).select("doc.c_custkey", "doc.c_name")


ENRICHED = """
SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL))[1:3], ',') AS first_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
"""


@query(ENRICHED)
def recompute_full(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with what is known of their orders; the first slice of the engine."""
    docs = c.documents(spark, sf, "orders", "customer")
    made = recompute.recompute(c.together(docs), c.edges_of(docs), c.customer_config()).where("status = 'OK'").select("doc.*")
    return made.select("c_custkey", "c_name", "n_orders", F.col("total").cast("double").alias("total"), F.array_join("first_orders", ",").alias("first_orders"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, bool_or(o_orderkey % 50 = 0) AS late FROM orders GROUP BY o_custkey)
SELECT 'best/customer/' || c_custkey AS key, CASE WHEN c_acctbal <= 0 THEN 'FILTERED' WHEN coalesce(late, false) THEN 'EXPIRED' ELSE 'OK' END AS status,
CASE WHEN c_acctbal > 0 AND NOT coalesce(late, false) THEN upper(c_name) END AS name, CASE WHEN c_acctbal > 0 AND NOT coalesce(late, false) THEN coalesce(n, 0) END AS c_nationkey,
CASE WHEN c_acctbal > 0 AND NOT coalesce(late, false) THEN total END AS total, CASE WHEN c_acctbal > 0 AND NOT coalesce(late, false) THEN n_name END AS nation
FROM customer LEFT JOIN o ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def recompute_everything(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, transformation, walks in both directions, properties that replace fields, and expiry: every 50th order is newer in the store than in the graph."""
    docs, edges = c.star(spark, sf)
    vertices = graph.vertices(c.keys_of(docs), edges)
    docs["orders"] = docs["orders"].withColumn("version", F.when(F.col("doc")["o_orderkey"] % 50 == 0, 2).otherwise(1).cast("long"))
    into = Walk("orders", IN, (Property("c_nationkey", lambda d: F.count("*"), empty=0), Property("total", lambda d: F.sum(d["o_totalprice"].cast("decimal(18,2)")))), depth=1)
    out = Walk("nation", OUT, (Property("nation", lambda d: F.max(d["n_name"])),), depth=1)
    shape = lambda d: F.struct(F.upper(d["c_name"]).alias("name"), d["c_nationkey"].alias("c_nationkey"))
    cfg = SourceConfig("best", "customer", "shop", "customer", filter=lambda d: d["c_acctbal"] > 0, transform=shape, walks=(into, out))
    made = recompute.recompute(c.together(docs), edges, cfg, vertices=vertices)
    return made.select(key_text("key").alias("key"), "status", "doc.name", "doc.c_nationkey", F.col("doc.total").cast("double").alias("total"), "doc.nation")


@query("""
SELECT 'enriched/customer/' || c_custkey AS key, 'OK' AS status, '["shop","customer","' || c_custkey || '",1]' AS from_source FROM customer
""")
def target_from_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_documents(spark, sf, "customer")
    made = recompute.recompute(docs, c.edges_of({"customer": docs}), SourceConfig("enriched", "customer", "shop", "customer"))
    return made.select(key_text("key").alias("key"), "status", codecs.id_json(F.col("from_source")["key"], F.col("from_source")["version"]).alias("from_source"))


@query("""
SELECT n_nationkey, count(c_custkey) AS customers, any_value(r_name) AS region FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_nationkey
""")
def recompute_two_walks(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "customer", "nation", "region")
    into = Walk("in", IN, (Property("customers", lambda d: F.count("*"), empty=0),), depth=1)
    out = Walk("out", OUT, (Property("region", lambda d: F.first(d["r_name"])),), depth=1)
    made = recompute.recompute(c.together(docs), c.edges_of(docs), SourceConfig("enriched", "place", "shop", "nation", walks=(into, out)))
    return made.select("doc.n_nationkey", "doc.customers", "doc.region")


@query("""
WITH s AS (SELECT CASE WHEN c_acctbal <= 0 THEN 'FILTERED' ELSE 'OK' END AS status FROM customer) SELECT status, 'INFO' AS severity, 200 AS http_code, count(*) AS n FROM s GROUP BY status
""")
def recompute_status(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_documents(spark, sf, "customer")
    made = recompute.outcomes(recompute.recompute(docs, extract(docs, RICH.extract), RICH))
    return made.groupBy("status", "severity", "http_code").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'NOT_AN_OBJECT' ELSE 'OK' END AS status FROM events")
def status_not_object(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_documents(spark, sf, "events", "log")
    cfg = SourceConfig("target", "event", "log", "events", transform=lambda d: F.when(d["event_type"] != "view", F.struct(d["props"].alias("props"))))
    none = c.literal_edges(spark, [("a", "b")])
    return recompute.recompute(docs, none, cfg).select(F.col("from_source")["key"]["id"].cast("long").alias("event_id"), "status")


@query("""
SELECT event_type AS request, CASE WHEN bool_or(value IS NULL OR value < 10) THEN 'ERROR' ELSE 'INFO' END AS severity, max(CASE WHEN value IS NULL OR value < 10 THEN 400 ELSE 200 END) AS http_code, count(*) AS results FROM events GROUP BY event_type
""")
def request_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.when(F.col("value").isNull() | (F.col("value") < 10), "EXPIRED").otherwise("OK")
    return recompute.request_outcome(e.select(F.col("event_type").alias("request"), status.alias("status")), "request")


# --- dirty propagation


CHANGED = "o_orderkey % 100 = 7"


def changed_keys(docs: dict[str, DataFrame]) -> DataFrame:
    return docs["orders"].where(F.col("doc")["o_orderkey"] % 100 == 7).select("key")


UPWARDS = f"""
SELECT 'shop/orders/' || o_orderkey AS key FROM orders WHERE {CHANGED} UNION SELECT 'shop/customer/' || o_custkey FROM orders WHERE {CHANGED}
UNION SELECT 'shop/nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {CHANGED}
UNION SELECT 'shop/region/' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE {CHANGED}
"""


@query(UPWARDS)
def dirty_set(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    return dirty.affected(edges, changed_keys(docs)).select(key_text("key").alias("key"))


@query(f"""
WITH k AS ({UPWARDS}), t AS (SELECT key, split_part(key, '/', 2) AS kind FROM k)
SELECT key, 1::BIGINT AS version, 'audit' AS target_index, 'any' AS target_type FROM t
UNION ALL SELECT key, 1, 'enriched', CASE kind WHEN 'orders' THEN 'order' WHEN 'customer' THEN 'customer' ELSE 'place' END FROM t WHERE kind <> 'region'
""")
def dirty_requests(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    keys = dirty.affected(edges, changed_keys(docs))
    made = dirty.requests(keys, graph.vertices(c.keys_of(docs), edges), c.registry())
    return made.select(key_text("key").alias("key"), "version", "target_index", "target_type")


@query("""
SELECT 'shop/orders/' || o_orderkey AS key FROM orders WHERE o_orderkey % 7 = 0
UNION SELECT 'shop/customer/' || o_custkey FROM orders WHERE o_orderkey % 7 = 0
UNION SELECT 'shop/customer/' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'new' END FROM orders WHERE o_orderkey % 7 = 0
""")
def dirty_pre_post(spark: SparkSession, sf: str) -> DataFrame:
    committed, edges, batch, new = changed_orders(spark, sf)
    _, after, _ = graph.commit(committed, edges, batch, new)
    changed = batch.where("version > 0").select("key")
    return dirty.around_commit(edges, after, changed, (OUT,)).select(key_text("key").alias("key"))


@query("""
SELECT 'shop/orders/' || o_orderkey AS key FROM orders WHERE o_custkey % 10 = 0
UNION SELECT 'shop/nation/' || c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 <> 0) AND c_custkey % 10 = 0
""")
def dirty_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    before, after, edges, _, gone = deleted_customers(spark, sf)
    return dirty.after_delete(edges, before, after, gone).select(key_text("key").alias("key"))


@query(f"""
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT o_orderkey, {MOVED} AS cust FROM orders) ON cust = c_custkey::VARCHAR GROUP BY c_custkey
""")
def recompute_incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """Targets after a batch of changes, of which only the affected documents are recomputed."""
    docs = c.documents(spark, sf, "orders", "customer")
    committed, edges, batch, new = changed_orders(spark, sf)
    w = Walk("orders", IN, (Property("n_orders", lambda d: F.count("*"), empty=0),), depth=1)
    cfg, store = SourceConfig("enriched", "customer", "shop", "customer", walks=(w,)), c.together(docs)
    old = recompute.recompute(store, edges, cfg).where("status = 'OK'").drop("status")
    _, after, _ = graph.commit(committed, edges, batch, new)
    after = checkpointed(after)
    keys = dirty.around_commit(edges, after, batch.where("version > 0").select("key"), (OUT,))
    now = recompute.upsert(old, recompute.recompute(store, after, cfg, only=keys))
    return now.select("doc.c_custkey", "doc.n_orders")


# --- change feeds

LOG = "SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events"


@query(f"SELECT CASE WHEN event_type = 'purchase' THEN 'DELETE' ELSE 'UPDATE' END || ',user,' || version || ',0,' || user_id AS line, 'users/user/' || user_id AS key, version FROM ({LOG})")
def cdc_changes(spark: SparkSession, sf: str) -> DataFrame:
    log = c.change_log(spark, sf)
    k = F.col("key")
    lines = log.select(codecs.change_text(F.col("action"), k["type"], F.col("version"), F.col("retries"), k["id"]).alias("value"))
    parsed = changes.parsed(lines, "users")
    line = codecs.change_text(F.col("action"), k["type"], F.col("version"), F.col("retries"), k["id"])
    return parsed.select(line.alias("line"), key_text("key").alias("key"), "version")


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def cdc_private_filter(spark: SparkSession, sf: str) -> DataFrame:
    log = c.change_log(spark, sf).withColumn("key", key(F.when(F.col("event_type") == "view", "_hidden").otherwise("users"), "user", F.col("key")["id"]))
    return changes.public_only(log).select("event_id")


@query(f"""
SELECT 'users/user/' || user_id AS key, max(version) AS version, CASE WHEN arg_max(event_type, version) = 'purchase' THEN 'DELETE' ELSE 'UPDATE' END AS action FROM ({LOG}) GROUP BY user_id
""")
def cdc_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return changes.latest(c.change_log(spark, sf)).select(key_text("key").alias("key"), "version", "action")


@query("SELECT 'users' AS index, count(*) AS waiting FROM events")
def cdc_queue_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.queue_sizes(c.change_log(spark, sf))


def failures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return backoff(e.select("event_id", (F.col("event_id") % 12).cast("int").alias("retries")), F.lit(0).cast("long"))


@query("SELECT event_id, (event_id % 12 + 1)::INT AS retries, (event_id % 12 + 1) * 10000 AS due FROM events WHERE event_id % 12 + 1 <= 10")
def cdc_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return split_dead(failures(spark, sf))[0]


@query("SELECT event_id, (event_id % 12 + 1)::INT AS retries FROM events WHERE event_id % 12 + 1 > 10")
def cdc_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    return split_dead(failures(spark, sf))[1]


@query("""
SELECT path, action, scope, index, type, id, version, valid FROM (VALUES
('/shop', 'DELETE', 'INDEX', 'shop', NULL, NULL, NULL::BIGINT, true), ('/shop/customer', 'DELETE', 'TYPE_IN_INDEX', 'shop', 'customer', NULL, NULL, true),
('/shop/customer/7', 'UPDATE', 'DOCUMENT_ANY_VERSION', 'shop', 'customer', '7', NULL, false), ('/shop/customer/7/3', 'UPDATE', 'DOCUMENT', 'shop', 'customer', '7', 3, true),
('/shop/customer/7/x', 'DELETE', 'DOCUMENT', 'shop', 'customer', '7', NULL, false), ('/', 'UPDATE', NULL, NULL, NULL, NULL, NULL, false)) v(path, action, scope, index, type, id, version, valid)
""")
def request_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("DELETE", "/shop"), ("DELETE", "/shop/customer"), ("GET", "/shop/customer/7"), ("GET", "/shop/customer/7/3"), ("DELETE", "/shop/customer/7/x"), ("GET", "/")]
    return req.decode(spark.createDataFrame(rows, "method string, path string")).drop("method")


@query("""
SELECT 'shop/customer/' || c_custkey AS key, unnest(['enriched/customer', 'audit/any']) AS target FROM customer UNION ALL SELECT 'shop/region/' || r_regionkey, 'audit/any' FROM region
UNION ALL SELECT 'web/pages/' || url, NULL FROM pages
""")
def config_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.documents(spark, sf, "customer", "region")
    keys = c.keys_of(docs).select("key").unionByName(c.pages(spark, sf).select("key"))
    found = req.match_configs(keys, c.registry().table(spark))
    return found.select(key_text("key").alias("key"), F.when(F.col("target_index").isNotNull(), F.concat_ws("/", "target_index", "target_type")).alias("target"))


# --- deltas

DELTA = """
SELECT 'shop/orders/' || o_orderkey || '--placed_by->shop/customer/' || {} AS name FROM orders WHERE o_orderkey % 7 = 0 AND {} <> o_custkey::VARCHAR
"""


@query(f"SELECT 'ae' AS op, name FROM ({DELTA.format(MOVED, MOVED)}) UNION ALL SELECT 'de', name FROM ({DELTA.format('o_custkey', MOVED)})")
def delta_edges(spark: SparkSession, sf: str) -> DataFrame:
    committed, edges, batch, new = changed_orders(spark, sf)
    _, after, _ = graph.commit(committed, edges, batch, new)
    return delta.edges(edges, after).select("op", "name")


@query("""
SELECT 'cn' AS op, 'shop/orders/' || o_orderkey AS name, '2' AS version FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'an', 'shop/customer/new', '0' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 14 = 7)
""")
def delta_nodes(spark: SparkSession, sf: str) -> DataFrame:
    committed, edges, batch, new = changed_orders(spark, sf)
    now, after, _ = graph.commit(committed, edges, batch, new)
    return delta.nodes(graph.vertices(committed, edges), graph.vertices(now, after)).select("op", "name", F.col("props")["version"].alias("version"))


@query("""
SELECT 'an' AS op, 'shop/nation/' || n_nationkey AS name, '{"an":{"shop/nation/' || n_nationkey || '":{"version":"1","size":"1"}}}' AS command FROM nation
""")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    v = table_documents(spark, sf, "nation").select("key", "version")
    return delta.encoded(delta.nodes(v.where("version < 0"), v))


@query(f"""
WITH e AS ({STAR_EDGES}) SELECT 'an' AS op, tail AS name FROM e UNION SELECT 'an', head FROM e
UNION ALL SELECT 'ae', tail || '--' || label || '->' || head FROM e
""")
def delta_unfold(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = c.star(spark, sf)
    return delta.unfold(edges, c.keys_of(docs))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'removed' WHEN o_orderkey % 10 = 2 THEN 'added' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)
""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    n = F.col("o_orderkey") % 10
    return delta.snapshots(o.where(n != 2), o.where(n != 1).withColumn("o_orderstatus", F.when(n == 3, "changed").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS files, true AS same FROM pages")
def directory_state(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    a, b = delta.state_hash(p, "url", "html"), delta.state_hash(p.orderBy(F.desc("url")), "url", "html")
    return a.join(b.select(F.col("state").alias("again")), F.col("state") == F.col("again"), "left").select("files", F.col("again").isNotNull().alias("same"))


# --- scalars


@query("""
SELECT doc_id, substr(text, 3, 8) AS part, strpos(text, 'the') - 1 AS at, length(trim(lower(text))) AS size, regexp_extract(url_like, '^src([0-9]+)', 1) AS number, text = '' AS empty FROM (SELECT *, source AS url_like FROM documents)
""")
def scalar_string(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", scalars.slice_text(t, 2, 10).alias("part"), scalars.index_of(t, "the").cast("long").alias("at"), F.length(F.trim(F.lower(t))).cast("long").alias("size"), scalars.groups(F.col("source"), "^src([0-9]+)", 1)[0].alias("number"), scalars.is_empty(t).alias("empty"))


@query("""
SELECT item_id, len(w) AS n, list_bool_or(list_transform(w, lambda x: length(x) > 12)) AS has_long, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS letters, array_to_string(w[1:2], '-') AS first
FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
""")
def scalar_array(spark: SparkSession, sf: str) -> DataFrame:
    w = scalars.words(F.col("text"))
    total = scalars.fold(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return table(spark, sf, "benchmark").select("item_id", F.size(w).cast("long").alias("n"), scalars.some(w, lambda x: F.length(x) > 12).alias("has_long"), total.alias("letters"), F.array_join(F.slice(w, 1, 2), "-").alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, array_to_string(json_keys(props), ',') AS names FROM events")
def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"), F.array_join(scalars.keys_of(F.col("props")), ",").alias("names"))


# --- fixtures


@query("""
SELECT 'shop/events/' || event_id AS key, CASE WHEN event_id % 10 = 1 THEN 'different' WHEN event_id % 10 = 2 THEN 'missing' WHEN event_id % 10 = 3 THEN 'unexpected' ELSE 'equal' END AS result FROM events
""")
def fixture_verify(spark: SparkSession, sf: str) -> DataFrame:
    e = table_documents(spark, sf, "events")
    n = F.col("doc")["event_id"] % 10
    actual = e.where(n != 2).select("key", F.when(n == 1, F.lit('{"k": -1}')).otherwise(F.col("doc")["props"]).alias("source"))
    expected = e.where(n != 3).select("key", F.concat(F.lit(" "), F.col("doc")["props"]).alias("source"))
    return fixtures.verify(actual, expected).select(key_text("key").alias("key"), "result")


@query("SELECT count(*) FILTER (WHERE event_id % 10 NOT IN (1, 2, 3)) AS passed, count(*) FILTER (WHERE event_id % 10 IN (1, 2, 3)) AS failed FROM events")
def fixture_tally(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.tally(fixture_verify(spark, sf))


DRAW = "(('0x' || substr(md5('1-{}-' || n), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""
WITH v AS (SELECT c_custkey - 1 AS n FROM customer), d AS (SELECT n, floor({DRAW.format("a")} * n)::BIGINT AS a, floor({DRAW.format("b")} * n)::BIGINT AS b FROM v WHERE {DRAW.format("keep")} > 0.8)
SELECT 'random/v/' || a AS tail, 'edge' AS label, 'random/v/' || b AS head FROM d WHERE a <> b
""")
def random_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A vertex for each customer, in the order of their numbers."""
    return edge_rows(graph.random_graph(table(spark, sf, "customer").select((F.col("c_custkey") - 1).cast("long").alias("n")), 0.8))


@query("""
SELECT 'shop/orders/' || o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'INVALID_REQUEST' WHEN o_orderkey % 7 = 0 THEN 'NO_CONFIGURATION' WHEN o_orderkey % 5 = 0 THEN 'NOT_IN_GRAPH'
WHEN o_orderkey % 3 = 0 THEN 'SOURCE_MISSING' WHEN o_orderkey % 2 = 0 THEN 'EXPIRED' ELSE 'OK' END AS outcome,
CASE WHEN outcome IN ('OK', 'NO_CONFIGURATION') THEN '{"status":"ok","severity":"info","code":200,"outcome":"' ELSE '{"status":"error","severity":"error","code":400,"outcome":"' END || outcome || '"}' AS response FROM orders
""")
def request_judged(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each order: by its number it is faulty, of an index without configuration, unknown to the graph, missing in the store, too old, or fine."""
    docs = table_documents(spark, sf, "orders")
    n = F.col("doc")["o_orderkey"]
    mine = key(F.when((n % 7 == 0) & (n % 11 != 0), F.lit("nowhere")).otherwise(F.lit("shop")), "orders", F.col("key")["id"])
    asked = docs.select(mine.alias("key"), F.when(n % 2 == 0, 2).otherwise(1).cast("long").alias("version"), (n % 11 != 0).alias("valid"))
    made = req.judged(asked, docs.where(n % 3 != 0), docs.where(n % 5 != 0).select("key", "version"), c.registry().table(spark))
    return recompute.rendered(made).select(F.concat(F.lit("shop/orders/"), F.col("key")["id"]).alias("key"), F.col("status").alias("outcome"), "response")


@query("""
SELECT event_id, floor(value + 0.5)::BIGINT AS rounded, trunc(-value)::BIGINT AS whole, least(greatest(value, 10), 20) AS clamped,
epoch_us(ts::TIMESTAMP) // 1000 AS ms, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, dayofweek(ts)::INT AS weekday, epoch_us(ts::TIMESTAMP) // 1000 AS again FROM events
""")
def scalar_math_date(spark: SparkSession, sf: str) -> DataFrame:
    v, t = F.col("value"), F.col("ts")
    ms = scalars.epoch_ms(t)
    return table(spark, sf, "events").select(
        "event_id", scalars.half_up(v).cast("long").alias("rounded"), scalars.truncated(-v).cast("long").alias("whole"), scalars.clamped(v, 10.0, 20.0).alias("clamped"),
        ms.alias("ms"), scalars.iso(t).alias("iso"), scalars.weekday(t).alias("weekday"), scalars.epoch_ms(scalars.from_epoch_ms(ms)).alias("again"),
    )


__all__ = ["QUERIES", "SQL", "oriented"]

"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import graph as G
from kestrel.operators.aggregate import correlation_matrix
from kestrel.operators.profile import cooccurrence
from kestrel.plans.common import SALES_SQL, sales
from kestrel.plans.registry import query
from kestrel.session import Tables


def _star(t: Tables):
    return G.star_graph(sales(t), "invoice", "customer", "product", "date", amount="amount")


def trade_graph(t: Tables):
    """Nations as nodes; customer-nation -> supplier-nation edges weighted by revenue."""
    li, o, c, s = t.lineitem, t.orders, t.customer, t.supplier
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    edges = j.groupBy(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("src"),
                      F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    edges = edges.where(F.col("src") != F.col("dst")).select("src", "dst", F.lit("buys_from").alias("relation"),
                                                             (F.lit(1e6) / F.col("revenue")).alias("weight"), "revenue")
    nodes = t.nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"),
                            F.lit("nation").alias("type"), F.col("n_name").alias("label"))
    return nodes, edges


TRADE_SQL = """trade AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst,
    1e6::DOUBLE / sum(l_extendedprice * (1 - l_discount))::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


STAR_EDGES_SQL = f"""{SALES_SQL},
r AS (SELECT CAST(invoice AS VARCHAR) AS inv, coalesce(customer, 'Unknown') AS cust,
  coalesce(CAST(product AS VARCHAR), 'General') AS prod, strftime(date, '%Y-%m-%d') AS day, amount FROM sales),
e AS (SELECT 'invoice:' || inv AS src, 'customer:' || cust AS dst, 'sold_to' AS relation FROM r
  UNION ALL SELECT 'invoice:' || inv, 'product:' || prod, 'contains' FROM r
  UNION ALL SELECT 'invoice:' || inv, 'date:' || day, 'occurred_on' FROM r
  UNION ALL SELECT 'customer:' || cust, 'product:' || prod, 'purchased' FROM r),
edges AS (SELECT src, dst, relation, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY ALL),
nodes AS (SELECT 'invoice:' || inv AS id, 'invoice' AS type, inv AS label, sum(amount) AS amount FROM r GROUP BY inv
  UNION ALL SELECT DISTINCT 'customer:' || cust, 'customer', cust, NULL::DOUBLE FROM r
  UNION ALL SELECT DISTINCT 'product:' || prod, 'product', prod, NULL::DOUBLE FROM r
  UNION ALL SELECT DISTINCT 'date:' || day, 'date', day, NULL::DOUBLE FROM r WHERE day IS NOT NULL)"""


@query("m01_extract_entities", f"""WITH {SALES_SQL},
l AS (SELECT 'customer' AS type, CAST(customer AS VARCHAR) AS label FROM sales
  UNION ALL SELECT 'product', CAST(product AS VARCHAR) FROM sales UNION ALL SELECT 'segment', segment FROM sales)
SELECT DISTINCT type || ':' || label AS id, type, label FROM l WHERE label IS NOT NULL AND trim(label) <> ''""")
def m01_extract_entities(spark, sf):
    return G.extract_entities(sales(Tables(spark, sf)), {"customer": "customer", "product": "product", "segment": "segment"})


@query("m03_star_graph_edges", f"WITH {STAR_EDGES_SQL} SELECT * FROM edges")
def m03_star_graph_edges(spark, sf):
    return _star(Tables(spark, sf))[1]


@query("m03b_star_graph_nodes", f"WITH {STAR_EDGES_SQL} SELECT * FROM nodes")
def m03b_star_graph_nodes(spark, sf):
    return _star(Tables(spark, sf))[0]


@query("m04_merge_graphs")
def m04_merge_graphs(spark, sf):
    t = Tables(spark, sf)
    s = sales(t).join(t.orders.select(F.col("o_orderkey").alias("invoice"), "o_orderstatus"), "invoice")
    g1 = G.star_graph(s.where(F.col("o_orderstatus") == "F"), "invoice", "customer", "product", "date", amount="amount")
    g2 = G.star_graph(s.where(F.col("o_orderstatus") != "F"), "invoice", "customer", "product", "date", amount="amount")
    return G.merge_graphs([g1, g2])[0]


@query("m05_graph_stats", f"""WITH {STAR_EDGES_SQL},
n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS e FROM edges),
ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
iso AS (SELECT count(*) AS i FROM nodes WHERE id NOT IN (SELECT id FROM ends))
SELECT n AS nodes, e AS edges, e / (n * (n - 1)) AS density, 2.0 * e / n AS avg_degree, i * 100.0 / n AS isolated_pct
FROM n, m, iso""")
def m05_graph_stats(spark, sf):
    nodes, edges = _star(Tables(spark, sf))
    return G.graph_stats(nodes, edges)


@query("m05b_nodes_by_type", f"WITH {STAR_EDGES_SQL} SELECT type, count(*) AS count FROM nodes GROUP BY type")
def m05b_nodes_by_type(spark, sf):
    return G.nodes_by_type(_star(Tables(spark, sf))[0])


@query("m06_flatten_graph")
def m06_flatten_graph(spark, sf):
    nodes, edges = _star(Tables(spark, sf))
    return G.flatten_star(nodes, edges)


@query("m07_match_nodes", f"""WITH {STAR_EDGES_SQL}
SELECT * FROM nodes WHERE contains(lower(id), 'customer#00000001') OR contains(lower(label), 'customer#00000001')
  OR type = 'customer#00000001' OR contains(lower(id), 'date') OR contains(lower(label), 'date') OR type = 'date'""")
def m07_match_nodes(spark, sf):
    return G.match_nodes(_star(Tables(spark, sf))[0], ["Customer#00000001", "date"])


@query("m08_pagerank")
def m08_pagerank(spark, sf):
    nodes, edges = trade_graph(Tables(spark, sf))
    return G.pagerank(nodes, G.undirected(edges.withColumn("weight", F.col("revenue")).drop("revenue")))


@query("m09_top_neighbours")
def m09_top_neighbours(spark, sf):
    nodes, edges = trade_graph(Tables(spark, sf))
    und = G.undirected(edges.withColumn("weight", F.col("revenue")).drop("revenue"))
    return G.top_neighbours(und, G.pagerank(nodes, und), "nation:0", 5)


@query("m10_bfs_paths", f"""WITH {STAR_EDGES_SQL},
u AS (SELECT DISTINCT src, dst FROM edges UNION SELECT dst, src FROM edges),
z AS (SELECT 'customer:' || min(c_name) AS id FROM customer),
h1 AS (SELECT dst AS id, z.id AS parent FROM u, z WHERE src = z.id AND dst <> z.id),
h2 AS (SELECT u.dst AS id, min(h1.id) AS parent FROM h1 JOIN u ON u.src = h1.id
  WHERE u.dst NOT IN (SELECT id FROM h1) AND u.dst NOT IN (SELECT id FROM z) GROUP BY u.dst)
SELECT id, 0 AS hops, NULL AS parent, [id] AS path FROM z
UNION ALL SELECT id, 1, parent, [parent, id] FROM h1
UNION ALL SELECT h2.id, 2, h2.parent, [z.id, h2.parent, h2.id] FROM h2, z""")
def m10_bfs_paths(spark, sf):
    t = Tables(spark, sf)
    _, edges = _star(t)
    first = t.customer.agg(F.concat(F.lit("customer:"), F.min("c_name"))).first()[0]
    return G.bfs(G.undirected(edges), first, max_hops=2)


@query("m11_simple_paths", f"""WITH {TRADE_SQL}
SELECT [src, dst] AS path, 1 AS hops FROM trade WHERE src = 'nation:0' AND dst = 'nation:1'
UNION ALL SELECT [a.src, a.dst, b.dst], 2 FROM trade a JOIN trade b ON a.dst = b.src
  WHERE a.src = 'nation:0' AND b.dst = 'nation:1' AND a.dst <> 'nation:1'""")
def m11_simple_paths(spark, sf):
    _, edges = trade_graph(Tables(spark, sf))
    return G.simple_paths(edges.drop("revenue"), "nation:0", "nation:1", max_hops=2)


@query("m12_shortest_path")
def m12_shortest_path(spark, sf):
    _, edges = trade_graph(Tables(spark, sf))
    return G.shortest_path(edges.drop("revenue"), "nation:0", max_hops=3)


@query("m13_importance_walk")
def m13_importance_walk(spark, sf):
    nodes, edges = trade_graph(Tables(spark, sf))
    und = G.undirected(edges.withColumn("weight", F.col("revenue")).drop("revenue"))
    return G.importance_walk(und, G.pagerank(nodes, und), "nation:0", 5)


@query("m15_type_subgraph", f"WITH {STAR_EDGES_SQL} SELECT * FROM edges WHERE relation = 'purchased'")
def m15_type_subgraph(spark, sf):
    nodes, edges = _star(Tables(spark, sf))
    return G.subgraph(nodes, edges, ["customer", "product"])[1]


@query("m16_cooccurrence_graph")
def m16_cooccurrence_graph(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return G.cooccurrence_graph(cooccurrence(j, ["o_orderstatus", "o_orderpriority", "c_mktsegment"]))


@query("m17_correlation_graph", """WITH l AS (SELECT l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, (l_extendedprice * (1 - l_discount))::DOUBLE AS amount
  FROM lineitem), c AS (SELECT corr(q, p) AS qp, corr(q, amount) AS qa, corr(p, amount) AS pa FROM l),
r AS (SELECT 'l_quantity' AS src, 'l_extendedprice' AS dst, qp AS r FROM c UNION ALL SELECT 'l_quantity', 'amount', qa FROM c
  UNION ALL SELECT 'l_extendedprice', 'amount', pa FROM c)
SELECT src, dst, 'correlated' AS relation, abs(r) AS weight FROM r WHERE abs(r) > 0.3""")
def m17_correlation_graph(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("amount", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return G.correlation_graph(correlation_matrix(li, ["l_quantity", "l_extendedprice", "amount"]), 0.3)

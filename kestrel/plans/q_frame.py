"""Registered queries for projection, filters, joins, sort/limit and set ops
(SURVEY §2.B, C, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import frame
from kestrel.plans.registry import query
from kestrel.session import Tables

# ------------------------------------------------------------------ B


@query("b01_rename", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def b01_rename(spark, sf):
    return frame.rename_columns(Tables(spark, sf).nation, {"n_nationkey": "nation_id", "n_name": "nation",
                                                           "not_there": "ignored"})


@query("b02_typed_cast", """SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, TRY_CAST(c_mktsegment AS DOUBLE) AS c_mktsegment
FROM customer""")
def b02_typed_cast(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return frame.convert_column_types(c, {"c_acctbal": "int", "c_nationkey": "str", "c_mktsegment": "float"})


@query("b02b_cast_error_list", """SELECT * FROM (VALUES ('c_acctbal', 0::BIGINT), ('c_mktsegment',
  (SELECT count(*) FROM customer WHERE c_mktsegment IS NOT NULL)::BIGINT)) t("column", failed)""")
def b02b_cast_error_list(spark, sf):
    c = Tables(spark, sf).customer
    return frame.convert_column_types_with_errors(c, {"c_acctbal": "int", "c_mktsegment": "float"})[1]


@query("b03_filter_conjunctive", """SELECT * FROM lineitem
WHERE l_returnflag IS DISTINCT FROM 'R' AND l_quantity >= 10 AND l_discount <= 0.05 AND l_linestatus IN ('O')""")
def b03_filter_conjunctive(spark, sf):
    return frame.filter_data(Tables(spark, sf).lineitem, [
        {"column": "l_returnflag", "operator": "!=", "value": "R"},
        {"column": "l_quantity", "operator": ">=", "value": 10},
        {"column": "l_discount", "operator": "<=", "value": 0.05},
        {"column": "l_linestatus", "operator": "in", "value": ["O"]},
        {"column": "no_such_column", "operator": "=", "value": 1}])


@query("b03b_filter_like", """SELECT * FROM part
WHERE regexp_matches(p_type, 'eco', 'i') AND regexp_matches(p_name, 'ring|bolt', 'i')""")
def b03b_filter_like(spark, sf):
    return frame.filter_data(Tables(spark, sf).part, [
        {"column": "p_type", "operator": "like", "value": "eco"},
        {"column": "p_name", "operator": "like", "value": "ring|bolt"}])


@query("b04_cross_filter", """SELECT * FROM customer
WHERE CAST(c_mktsegment AS VARCHAR) = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) = '3'""")
def b04_cross_filter(spark, sf):
    return frame.cross_filter(Tables(spark, sf).customer, {"c_mktsegment": "BUILDING", "c_nationkey": "3",
                                                           "c_name": "all"})


@query("b04b_slicer_options", """WITH kv AS (
  SELECT 'o_orderstatus' AS dimension, CAST(o_orderstatus AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
d AS (SELECT DISTINCT dimension, value FROM kv WHERE value IS NOT NULL),
c AS (SELECT dimension, count(*) AS n FROM d GROUP BY dimension)
SELECT d.dimension, d.value FROM d JOIN c ON d.dimension = c.dimension WHERE c.n < 20""")
def b04b_slicer_options(spark, sf):
    return frame.slicer_options(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], 20)


@query("b05_date_range", """SELECT * FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def b05_date_range(spark, sf):
    return frame.date_range(Tables(spark, sf).orders, "o_orderdate", "1996-01-01", "1996-12-31")


@query("b06_relative_range", """SELECT * FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND ts <= (SELECT max(ts) FROM events)""")
def b06_relative_range(spark, sf):
    return frame.relative_range(Tables(spark, sf).events, "ts", days=7)


@query("b06b_previous_period", """SELECT * FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 14 DAY AND ts <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def b06b_previous_period(spark, sf):
    return frame.relative_range(Tables(spark, sf).events, "ts", days=7, offset_days=7, fallback_to_all=True)


@query("b07_search", """SELECT * FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring')""")
def b07_search(spark, sf):
    return frame.search(Tables(spark, sf).part, "RING")


@query("b08_drop_columns_by_rule", "SELECT c_acctbal, c_mktsegment FROM customer")
def b08_drop_columns_by_rule(spark, sf):
    return frame.drop_columns_by_rule(Tables(spark, sf).customer)


@query("b09_select_numeric", "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def b09_select_numeric(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select(*frame.select_by_type(li, "numeric", limit=10))


# ------------------------------------------------------------------ C


@query("c01_join_suffixes", """SELECT c.c_custkey, c.c_name, c.c_nationkey AS nationkey, c.c_acctbal AS acctbal_x,
       s.s_suppkey, s.s_name, s.s_acctbal AS acctbal_y
FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey""")
def c01_join_suffixes(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nationkey"),
                          F.col("c_acctbal").alias("acctbal"))
    s = t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("nationkey"),
                          F.col("s_acctbal").alias("acctbal"))
    return frame.join_tables(c, s, ["nationkey"], ["nationkey"], "inner", spread=True)  # a nation has many of both


@query("c01b_join_full_outer", """SELECT o.*, c.* FROM orders o FULL OUTER JOIN customer c ON o.o_custkey = c.c_custkey""")
def c01b_join_full_outer(spark, sf):
    t = Tables(spark, sf)
    return frame.join_tables(t.orders, t.customer, ["o_custkey"], ["c_custkey"], "outer")


@query("c02_aggregate_back", """SELECT o.*, f.first_order_date FROM orders o
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order_date FROM orders GROUP BY o_custkey) f
ON o.o_custkey = f.o_custkey""")
def c02_aggregate_back(spark, sf):
    return frame.aggregate_back(Tables(spark, sf).orders, "o_custkey", "o_orderdate", "min", "first_order_date")


@query("c03_topk_membership", """WITH k AS (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL
  GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 20)
SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k)""")
def c03_topk_membership(spark, sf):
    return frame.topk_membership(Tables(spark, sf).lineitem, "l_partkey", 20)


@query("c04_lookup_join", """SELECT c.*, coalesce(n.n_name, 'UNKNOWN') AS nation
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def c04_lookup_join(spark, sf):
    t = Tables(spark, sf)
    return frame.lookup_join(t.customer, t.nation, "c_nationkey", "n_nationkey", "n_name", "nation",
                             default="UNKNOWN", bounded=False)


SCENARIOS = [{"name": "base", "change": 0.0}, {"name": "up10", "change": 0.1}, {"name": "down5", "change": -0.05}]


@query("c06_scenario_join", """WITH seg AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
sc(scenario, change) AS (VALUES ('base', 0.0::DOUBLE), ('up10', 0.1::DOUBLE), ('down5', -0.05::DOUBLE))
SELECT seg.segment, seg.revenue, sc.scenario, sc.change, seg.revenue * (1 + sc.change) AS projected
FROM seg CROSS JOIN sc""")
def c06_scenario_join(spark, sf):
    t = Tables(spark, sf)
    seg = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("segment")).agg(F.sum("o_totalprice").alias("revenue"))
    out = frame.with_scenarios(seg, SCENARIOS)
    return out.withColumn("projected", F.col("revenue") * (1 + F.col("change")))


@query("c07_anti_join", """SELECT * FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def c07_anti_join(spark, sf):
    t = Tables(spark, sf)
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("c07b_semi_join", """SELECT * FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 50)""")
def c07b_semi_join(spark, sf):
    t = Tables(spark, sf)
    big = t.lineitem.where(F.col("l_quantity") >= 50)
    return t.part.join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


@query("c07c_asof_join", """SELECT l.*, r.last_purchase_value
FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, value AS last_purchase_value FROM events WHERE event_type = 'purchase') r
ON l.user_id = r.user_id AND l.ts >= r.ts""")
def c07c_asof_join(spark, sf):
    ev = Tables(spark, sf).events
    left = ev.where(F.col("event_type") != "purchase")
    right = ev.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("pts"), F.col("value").alias("last_purchase_value"))
    return frame.asof_join(left, right, ["user_id"], "ts", "pts", ["last_purchase_value"])


@query("c07d_range_join", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, o.o_orderdate
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY""")
def c07d_range_join(spark, sf):
    t = Tables(spark, sf)
    li, o = t.lineitem, t.orders
    cond = (li.l_orderkey == o.o_orderkey) & li.l_shipdate.between(
        o.o_orderdate, o.o_orderdate + F.expr("INTERVAL 30 DAYS"))
    return li.join(o, cond).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "o_orderdate")


# ------------------------------------------------------------------ F


@query("f01_order_limit", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def f01_order_limit(spark, sf):
    return frame.order_limit(Tables(spark, sf).orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("f02_top_n_ties", """SELECT * FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 15""")
def f02_top_n_ties(spark, sf):
    return frame.top_n(Tables(spark, sf).lineitem, "l_extendedprice", 15,
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("f03_sort_by_parsed", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f03_sort_by_parsed(spark, sf):
    o = Tables(spark, sf).orders.withColumn("price_text", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return frame.sort_by_parsed(o, "price_text", tie_breaker=["o_orderkey"]).limit(20).select("o_orderkey", "o_totalprice")


@query("f04_preview")
def f04_preview(spark, sf):
    return frame.preview(Tables(spark, sf).lineitem, 100, 7)


# ------------------------------------------------------------------ G


@query("g01_union_all", "SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O'")
def g01_union_all(spark, sf):
    o = Tables(spark, sf).orders
    return frame.union_all([o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O")])


@query("g02_duplicate_count", """SELECT count(*) AS n_rows,
  (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates
FROM lineitem""")
def g02_duplicate_count(spark, sf):
    return frame.duplicate_count(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query("g02b_drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def g02b_drop_duplicates(spark, sf):
    return frame.drop_exact_duplicates(Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("g04_intersect", """SELECT o_custkey AS custkey FROM orders
INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def g04_intersect(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.select(F.col("o_custkey").alias("custkey"))
    b = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("custkey"))
    return frame.intersect(a, b)


@query("g04b_except_all", """SELECT l_partkey AS partkey FROM lineitem WHERE l_quantity > 40
EXCEPT ALL SELECT p_partkey FROM part WHERE p_size > 25""")
def g04b_except_all(spark, sf):
    t = Tables(spark, sf)
    a = t.lineitem.where(F.col("l_quantity") > 40).select(F.col("l_partkey").alias("partkey"))
    b = t.part.where(F.col("p_size") > 25).select(F.col("p_partkey").alias("partkey"))
    return frame.except_(a, b, all_rows=True)


@query("g05_dual_membership", """SELECT count(*) FILTER (WHERE l_quantity > 45) AS n_a,
  count(*) FILTER (WHERE l_discount > 0.08) AS n_b,
  count(*) FILTER (WHERE l_quantity > 45 AND l_discount > 0.08) AS n_both FROM lineitem""")
def g05_dual_membership(spark, sf):
    li = Tables(spark, sf).lineitem
    return frame.dual_membership(li, F.col("l_quantity") > 45, F.col("l_discount") > 0.08)


@query("e04_abc_grade_customers", """WITH t AS (SELECT c.c_name AS customer,
    sum(l.l_extendedprice * (1 - l.l_discount)) AS total, count(*) AS count
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY c.c_name),
r AS (SELECT customer, total, count, row_number() OVER (ORDER BY total DESC, customer) AS rank,
    total * 100 / sum(total) OVER () AS share_pct,
    sum(total) OVER (ORDER BY total DESC, customer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      * 100 / sum(total) OVER () AS cumulative_pct FROM t)
SELECT *, CASE WHEN cumulative_pct <= 70 THEN 'A' WHEN cumulative_pct <= 90 THEN 'B' ELSE 'C' END AS grade FROM r""")
def e04_abc_grade_customers(spark, sf):
    """Flagship: scan -> join -> revenue per customer -> ABC grade."""
    from kestrel.operators.windows import abc_grade
    from kestrel.plans.common import sales
    return abc_grade(sales(Tables(spark, sf)), "customer", "amount")

"""Registered chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import charts as Q
from kestrel.plans.common import SALES_SQL, sales
from kestrel.plans.registry import query
from kestrel.session import Tables


@query("q01_bar_top", f"""WITH {SALES_SQL}, g AS (SELECT segment, sum(amount) AS value FROM sales WHERE segment IS NOT NULL GROUP BY ALL)
SELECT segment, value, value / (SELECT sum(value) FROM g) * 100 AS percent FROM g ORDER BY value DESC, segment LIMIT 10""")
def q01_bar_top(spark, sf):
    return Q.bar(sales(Tables(spark, sf)), "segment", "amount")


@query("q03_funnel", """WITH g AS (SELECT event_type, count(*) AS count FROM events GROUP BY ALL ORDER BY count DESC, event_type LIMIT 6)
SELECT *, count / (SELECT max(count) FROM g) * 100 AS conversion_pct FROM g""")
def q03_funnel(spark, sf):
    return Q.funnel(Tables(spark, sf).events, "event_type")


@query("q05_waterfall", """WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS delta FROM orders GROUP BY ALL)
SELECT *, sum(delta) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS "end",
  sum(delta) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) - delta AS start FROM g""")
def q05_waterfall(spark, sf):
    return Q.waterfall(Tables(spark, sf).orders, "o_orderpriority", "o_totalprice")


@query("q06_radar")
def q06_radar(spark, sf):
    return Q.radar(sales(Tables(spark, sf)), "segment", ["amount", "quantity"])


@query("q07_sankey", f"""WITH {SALES_SQL},
g AS (SELECT segment, priority, sum(amount) AS value FROM sales GROUP BY ALL ORDER BY value DESC, segment, priority LIMIT 50),
n AS (SELECT DISTINCT node FROM (SELECT segment AS node FROM g UNION ALL SELECT priority FROM g)),
i AS (SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS idx FROM n)
SELECT g.segment, g.priority, g.value, a.idx AS source_idx, b.idx AS target_idx FROM g JOIN i a ON g.segment = a.node
JOIN i b ON g.priority = b.node""")
def q07_sankey(spark, sf):
    return Q.sankey(sales(Tables(spark, sf)), "segment", "priority", "amount")


@query("q08_ohlc", """SELECT date_trunc('day', ts) AS period, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close FROM events GROUP BY ALL""")
def q08_ohlc(spark, sf):
    return Q.ohlc(Tables(spark, sf).events, "ts", "value")


@query("q09_geo_totals", """SELECT n_name, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q09_geo_totals(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum("o_totalprice").alias("value"))


@query("q10_calendar", "SELECT CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY ALL")
def q10_calendar(spark, sf):
    return Q.calendar(Tables(spark, sf).events, "ts")


@query("q11_two_metrics", f"""WITH {SALES_SQL}
SELECT priority, sum(amount) AS amount, sum(quantity) AS quantity FROM sales GROUP BY ALL ORDER BY priority LIMIT 10""")
def q11_two_metrics(spark, sf):
    return Q.two_metrics(sales(Tables(spark, sf)), "priority", "amount", "quantity")


@query("q12_diverging", """WITH g AS (SELECT p_brand, avg(p_retailprice) AS mean FROM part GROUP BY ALL)
SELECT *, mean - (SELECT avg(mean) FROM g) AS deviation FROM g""")
def q12_diverging(spark, sf):
    return Q.diverging(Tables(spark, sf).part, "p_brand", "p_retailprice")


@query("q14_gauge", "SELECT avg(o_totalprice) AS value, max(o_totalprice) * 0.8 AS target FROM orders")
def q14_gauge(spark, sf):
    return Q.gauge(Tables(spark, sf).orders, "o_totalprice")


@query("q15_scatter_sample")
def q15_scatter_sample(spark, sf):
    return Q.scatter_sample(Tables(spark, sf).orders, "o_orderdate", "o_totalprice", ["o_orderkey"], 500, size="o_totalprice")


@query("q16_sunburst", """WITH c AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT NULL::VARCHAR AS parent, o_orderstatus AS node, sum(value) AS value FROM c GROUP BY ALL
UNION ALL SELECT o_orderstatus, o_orderpriority, value FROM c
  QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY value DESC, o_orderpriority) <= 15""")
def q16_sunburst(spark, sf):
    return Q.sunburst(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority", "o_totalprice")

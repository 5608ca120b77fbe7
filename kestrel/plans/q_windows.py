"""Registered window / ordered-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import windows as win
from kestrel.plans.common import SALES_SQL, sales
from kestrel.plans.registry import query
from kestrel.session import Tables

ORD = ["o_orderdate", "o_orderkey"]


def _monthly(t: Tables):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.sum("o_totalprice").alias("revenue"))


MONTHLY_SQL = "m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY ALL)"


def _daily_events(t: Tables):
    return t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))


DAILY_SQL = "d AS (SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL)"


@query("e01_cumulative_sum", """SELECT o_orderkey, o_orderdate, o_totalprice,
  sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
FROM orders""")
def e01_cumulative_sum(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return win.cumulative_sum(o, "o_totalprice", ORD)


@query("e01b_cumulative_sum_by_customer", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
  sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM orders""")
def e01b_cumulative_sum_by_customer(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return win.cumulative_sum(o, "o_totalprice", ORD, by=["o_custkey"])


SHARE_SQL = f"""WITH {SALES_SQL},
t AS (SELECT {{e}}, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total, count(*) AS count FROM sales
  WHERE {{e}} IS NOT NULL GROUP BY {{e}}),
cs AS (SELECT {{e}}, total, count, row_number() OVER (ORDER BY total DESC, {{e}}) AS rank,
  total / (SELECT sum(total) FROM t) * 100 AS share_pct,
  sum(total) OVER (ORDER BY total DESC, {{e}} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / (SELECT sum(total) FROM t) * 100 AS cumulative_pct FROM t)"""


@query("e02_contribution_top10", SHARE_SQL.format(e="product") + """
SELECT product, total, rank, share_pct, cumulative_pct FROM cs WHERE rank <= 10""")
def e02_contribution_top10(spark, sf):
    return win.contribution(sales(Tables(spark, sf)), "product", "amount", 10)


@query("e03_pareto", SHARE_SQL.format(e="customer") + """
SELECT *, cumulative_pct <= 80 OR rank = 1 AS vital FROM cs""")
def e03_pareto(spark, sf):
    return win.pareto(sales(Tables(spark, sf)), "customer", "amount")


@query("e03b_pareto_summary", SHARE_SQL.format(e="product") + """,
p AS (SELECT *, cumulative_pct <= 80 OR rank = 1 AS vital FROM cs)
SELECT count(*) FILTER (WHERE vital) AS vital_count, count(*) AS entities,
  count(*) FILTER (WHERE vital) * 100.0 / count(*) AS vital_pct_of_entities,
  sum(CASE WHEN vital THEN share_pct ELSE 0.0 END) AS vital_pct_of_value FROM p""")
def e03b_pareto_summary(spark, sf):
    return win.pareto_summary(sales(Tables(spark, sf)), "product", "amount")


@query("e04b_abc_grade_products", SHARE_SQL.format(e="product") + """
SELECT *, CASE WHEN cumulative_pct <= 70 THEN 'A' WHEN cumulative_pct <= 90 THEN 'B' ELSE 'C' END AS grade FROM cs""")
def e04b_abc_grade_products(spark, sf):
    return win.abc_grade(sales(Tables(spark, sf)), "product", "amount")


TIERS_SQL = f"""WITH {SALES_SQL},
t AS (SELECT customer, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total, count(*) AS count FROM sales
  WHERE customer IS NOT NULL GROUP BY customer),
r AS (SELECT *, total / count AS avg_order, row_number() OVER (ORDER BY total DESC, customer) AS rank,
  (row_number() OVER (ORDER BY total DESC, customer) - 1) * 100.0 / (SELECT count(*) FROM t) AS rank_pct FROM t),
tiers AS (SELECT *, CASE WHEN rank_pct <= 15 AND count >= 2 THEN 'Champions' WHEN rank_pct <= 35 THEN 'Loyal'
  WHEN rank_pct <= 60 THEN 'Potential' WHEN rank_pct <= 85 THEN 'At Risk' ELSE 'Needs Attention' END AS tier FROM r)"""


@query("e05_customer_tiers", TIERS_SQL + "\nSELECT * FROM tiers")
def e05_customer_tiers(spark, sf):
    return win.customer_tiers(sales(Tables(spark, sf)), "customer", "amount")


@query("e05b_tier_summary", TIERS_SQL + """
SELECT tier, count(*) AS customers, sum(total) AS revenue, avg(total) AS avg_revenue,
  sum(total) / (SELECT sum(total) FROM tiers) * 100 AS revenue_pct FROM tiers GROUP BY tier""")
def e05b_tier_summary(spark, sf):
    return win.tier_summary(win.customer_tiers(sales(Tables(spark, sf)), "customer", "amount"))


@query("e06_moving_average", """SELECT o_orderkey, o_orderdate, o_totalprice,
  CASE WHEN row_number() OVER w >= 7 THEN avg(o_totalprice) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS moving_avg
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def e06_moving_average(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return win.moving_average(o, "o_totalprice", ORD, window=7)


@query("e06b_moving_average_by_customer", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
  CASE WHEN row_number() OVER w >= 3 THEN avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS moving_avg
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def e06b_moving_average_by_customer(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return win.moving_average(o, "o_totalprice", ORD, window=3, by=["o_custkey"])


@query("e07_pct_change", f"""WITH {MONTHLY_SQL}
SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS revenue_prev,
  CASE WHEN lag(revenue) OVER (ORDER BY month) <> 0 THEN (revenue - lag(revenue) OVER (ORDER BY month))
    / lag(revenue) OVER (ORDER BY month) * 100 END AS pct_change,
  abs((revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100) > 10 AS significant
FROM m""")
def e07_pct_change(spark, sf):
    return win.pct_change(_monthly(Tables(spark, sf)), "revenue", ["month"])


@query("e08_year_over_year", """WITH y AS (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
l AS (SELECT *, lag(total) OVER (ORDER BY year) AS prev_total FROM y)
SELECT *, (total - prev_total) / abs(prev_total) * 100 AS growth_pct FROM l ORDER BY year DESC LIMIT 1""")
def e08_year_over_year(spark, sf):
    return win.year_over_year(Tables(spark, sf).orders, "o_orderdate", "o_totalprice")


@query("e09_cagr", """WITH y AS (SELECT c_mktsegment, year(o_orderdate) AS year, sum(o_totalprice) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT c_mktsegment, arg_min(total, year) AS first, arg_max(total, year) AS last, count(*) AS n FROM y GROUP BY ALL)
SELECT *, CASE WHEN first > 0 AND n > 1 THEN (pow(last / first, 1.0 / (n - 1)) - 1) * 100 END AS cagr_pct FROM g""")
def e09_cagr(spark, sf):
    t = Tables(spark, sf)
    y = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_mktsegment", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    return win.cagr(y, "total", "year", by=["c_mktsegment"])


@query("e10_momentum", f"""WITH {MONTHLY_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY month) AS rn, count(*) OVER () AS n FROM m),
j AS (SELECT a.revenue AS latest, b.revenue AS base FROM r a LEFT JOIN r b ON b.rn = a.rn - 3 WHERE a.rn = a.n)
SELECT latest, base, CASE WHEN base <> 0 THEN (latest - base) / abs(base) * 100 END AS roc_pct,
  CASE WHEN base IS NULL OR base = 0 THEN NULL WHEN (latest - base) / abs(base) * 100 > 5 THEN 'strong_up'
    WHEN (latest - base) / abs(base) * 100 > 0 THEN 'up' WHEN (latest - base) / abs(base) * 100 < -5 THEN 'strong_down'
    ELSE 'down' END AS momentum FROM j""")
def e10_momentum(spark, sf):
    return win.momentum(_monthly(Tables(spark, sf)), "revenue", ["month"], window=3)


@query("e11_half_split_change", """WITH r AS (SELECT o_orderpriority, o_totalprice,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS pos,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
g AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE pos <= floor(n / 2)) AS first_half_mean,
  avg(o_totalprice) FILTER (WHERE pos > floor(n / 2)) AS second_half_mean FROM r GROUP BY ALL)
SELECT *, (second_half_mean - first_half_mean) / abs(first_half_mean) * 100 AS change_pct FROM g""")
def e11_half_split_change(spark, sf):
    return win.half_split_change(Tables(spark, sf).orders, "o_totalprice", ORD, by=["o_orderpriority"])


@query("e12_four_periods", """WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
  count(*) OVER () AS n FROM orders),
g AS (SELECT CAST(least(floor((rn - 1) / greatest(floor(n / 4), 1)), 3) AS INTEGER) + 1 AS period,
  sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(*) AS count FROM r GROUP BY ALL),
l AS (SELECT *, (total - lag(total) OVER (ORDER BY period)) / abs(lag(total) OVER (ORDER BY period)) * 100 AS growth_pct FROM g)
SELECT *, total = (SELECT max(total) FROM g) AS is_best, total = (SELECT min(total) FROM g) AS is_worst FROM l""")
def e12_four_periods(spark, sf):
    return win.four_periods(Tables(spark, sf).orders, "o_totalprice", ORD)


@query("e13_segments", """WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
  count(*) OVER () AS n FROM orders)
SELECT CAST(floor((rn - 1) * 20 / n) AS INTEGER) AS segment, sum(o_totalprice) AS total, avg(o_totalprice) AS mean,
  stddev_samp(o_totalprice) AS std, count(*) AS count, min(rn) AS first_pos FROM r GROUP BY ALL""")
def e13_segments(spark, sf):
    return win.segments(Tables(spark, sf).orders, "o_totalprice", ORD, 20)


@query("e14_evenly_spaced", """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS _rn,
  count(*) OVER () AS n FROM orders),
idx AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 29) AS BIGINT) + 1 AS _rn FROM (SELECT max(n) AS n FROM r),
  range(0, 30) t(i))
SELECT r.* EXCLUDE (n) FROM r JOIN idx USING (_rn)""")
def e14_evenly_spaced(spark, sf):
    return win.evenly_spaced(Tables(spark, sf).orders, ORD, 30)


@query("e15_latest_vs_baseline", f"""WITH {DAILY_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) - 1 AS back FROM d),
g AS (SELECT event_type, sum(v) FILTER (WHERE back < 7) AS latest, sum(v) FILTER (WHERE back >= 7 AND back < 14) AS baseline
  FROM r GROUP BY ALL)
SELECT *, (latest - baseline) / abs(baseline) * 100 AS change_pct,
  (latest - baseline) / abs(baseline) * 100 < -15 AS alert FROM g""")
def e15_latest_vs_baseline(spark, sf):
    return win.latest_vs_baseline(_daily_events(Tables(spark, sf)), "v", ["day"], window=7, by=["event_type"])


@query("e16_ranked_entities_bottom", SHARE_SQL.format(e="product").split(",\ncs AS")[0] + """
SELECT product, total, count, row_number() OVER (ORDER BY total ASC, product) AS rank FROM t
ORDER BY total ASC, product LIMIT 10""")
def e16_ranked_entities_bottom(spark, sf):
    return win.ranked_entities(sales(Tables(spark, sf)), "product", "amount", 10, top=False)


@query("e17_dedupe_keep_first", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1""".replace("SELECT * FROM", "SELECT * EXCLUDE (rk) FROM"))
def e17_dedupe_keep_first(spark, sf):
    return win.dedupe(Tables(spark, sf).orders, ["o_custkey"], ORD, keep="first")


@query("e17b_dedupe_keep_last", """SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders) WHERE rk = 1""")
def e17b_dedupe_keep_last(spark, sf):
    return win.dedupe(Tables(spark, sf).orders, ["o_custkey"], ORD, keep="last")


@query("e17c_dedupe_keep_none", """SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL HAVING count(*) = 1)""")
def e17c_dedupe_keep_none(spark, sf):
    return win.dedupe(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"], keep="none")


def _gappy_events(t: Tables):
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return ev.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


GAPPY_SQL = """g AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


@query("e18_forward_fill", f"""WITH {GAPPY_SQL}
SELECT event_id, ts, user_id, event_type, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g""")
def e18_forward_fill(spark, sf):
    return win.fill(_gappy_events(Tables(spark, sf)), "value", ["ts", "event_id"], by=["user_id"])


@query("e18b_backward_fill", f"""WITH {GAPPY_SQL}
SELECT event_id, ts, user_id, event_type, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM g""")
def e18b_backward_fill(spark, sf):
    return win.fill(_gappy_events(Tables(spark, sf)), "value", ["ts", "event_id"], by=["user_id"],
                    direction="backward")


@query("e19_last_n_turns", """SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency_rank
FROM conversations QUALIFY recency_rank <= 3""")
def e19_last_n_turns(spark, sf):
    return win.last_n(Tables(spark, sf).conversations, ["conv_id"], ["turn"], 3)


@query("e20_autocorrelation", f"""WITH {DAILY_SQL},
l AS (SELECT event_type, v, lag(v, 7) OVER (PARTITION BY event_type ORDER BY day) AS v7,
  lag(v, 12) OVER (PARTITION BY event_type ORDER BY day) AS v12 FROM d)
SELECT event_type, 7 AS lag, corr(v, v7) AS acf, corr(v, v7) > 0.3 AS seasonal FROM l GROUP BY ALL
UNION ALL SELECT event_type, 12, corr(v, v12), corr(v, v12) > 0.3 FROM l GROUP BY ALL""")
def e20_autocorrelation(spark, sf):
    return win.autocorrelation(_daily_events(Tables(spark, sf)), "v", ["day"], lags=(7, 12), by=["event_type"])


@query("e21_top_dimension_trends", f"""WITH {SALES_SQL},
top AS (SELECT priority FROM sales WHERE priority IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, priority LIMIT 5),
g AS (SELECT priority, date_trunc('month', date) AS period, avg(amount) AS mean FROM sales
  WHERE priority IN (SELECT priority FROM top) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY priority ORDER BY period DESC) AS recency_rank FROM g
QUALIFY recency_rank <= 20""")
def e21_top_dimension_trends(spark, sf):
    return win.top_dimension_trends(sales(Tables(spark, sf)), "priority", "date", "amount")

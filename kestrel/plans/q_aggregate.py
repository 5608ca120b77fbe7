"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.operators import aggregate as agg
from kestrel.plans.common import SALES_SQL, sales
from kestrel.plans.registry import query
from kestrel.session import Tables

FX_VALUES_SQL = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(scalars.FX_RATES_TO_USD.items())) + ")"
CODES = sorted(scalars.FX_RATES_TO_USD)
CODES_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"


def customer_currency(t: Tables):
    """Customers with a currency derived from their nation (test mapping)."""
    return t.customer.withColumn("currency", F.element_at(F.array(*[F.lit(c) for c in CODES]),
                                                          (F.col("c_nationkey") % len(CODES) + 1).cast("int")))


CUSTOMER_CURRENCY_SQL = f"cc AS (SELECT *, {CODES_SQL}[c_nationkey % {len(CODES)} + 1] AS currency FROM customer)"


@query("d01_group_aggregate", """SELECT l_returnflag, l_linestatus,
  coalesce(sum(l_quantity), 0) AS l_quantity_sum, avg(l_quantity) AS l_quantity_avg, count(l_quantity) AS l_quantity_count,
  min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag, l_linestatus""")
def d01_group_aggregate(spark, sf):
    return agg.group_aggregate(Tables(spark, sf).lineitem, ["l_returnflag", "l_linestatus"],
                               {"l_quantity": ["sum", "avg", "count"], "l_extendedprice": ["min", "max"]})


@query("d01b_global_aggregate", """SELECT coalesce(sum(o_totalprice), 0) AS o_totalprice_sum,
  max(o_orderdate) AS o_orderdate_max FROM orders""")
def d01b_global_aggregate(spark, sf):
    return agg.group_aggregate(Tables(spark, sf).orders, [], {"o_totalprice": "sum", "o_orderdate": "max"})


@query("d02_group_aggregate_named", """SELECT o_orderpriority, count(DISTINCT o_custkey) AS o_custkey_nunique,
  median(o_totalprice) AS o_totalprice_median, stddev_samp(o_totalprice) AS o_totalprice_std,
  arg_min(o_totalprice, o_orderkey) AS o_totalprice_first, arg_max(o_totalprice, o_orderkey) AS o_totalprice_last
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def d02_group_aggregate_named(spark, sf):
    return agg.group_aggregate(Tables(spark, sf).orders, ["o_orderpriority"],
                               {"o_custkey": "nunique", "o_totalprice": ["median", "std", "first", "last"]},
                               order="o_orderkey")


@query("d03_column_stat", "SELECT stddev_samp(l_extendedprice) AS value FROM lineitem")
def d03_column_stat(spark, sf):
    return agg.column_stat(Tables(spark, sf).lineitem, "l_extendedprice", "std")


@query("d04_group_one_metric", """SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice_mean
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def d04_group_one_metric(spark, sf):
    return agg.group_aggregate(Tables(spark, sf).orders, ["o_orderpriority"], {"o_totalprice": "mean"})


_D5_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
D05_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
  coalesce(sum({c}), 0) AS sum, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS missing,
  quantile_cont({c}, 0.5) AS median FROM lineitem""" for c in _D5_COLS)


@query("d05_table_summary_numeric", D05_SQL)
def d05_table_summary_numeric(spark, sf):
    li = Tables(spark, sf).lineitem
    return agg.table_summary(li, numeric=_D5_COLS, categorical=["l_returnflag"])[0]


@query("d05b_table_summary_categorical", """WITH kv AS (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM kv WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT "column", count(*) AS n_distinct FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
SELECT r."column", r.value, r.n, r.rank, d.n_distinct FROM r JOIN d ON r."column" = d."column" WHERE rank <= 3""")
def d05b_table_summary_categorical(spark, sf):
    t = Tables(spark, sf)
    u = t.customer.select(F.col("c_mktsegment"), F.lit(None).cast("string").alias("o_orderpriority")).unionByName(
        t.orders.select(F.lit(None).cast("string").alias("c_mktsegment"), "o_orderpriority"))
    return agg.categorical_summary(u, ["c_mktsegment", "o_orderpriority"], 3)


@query("d06_entity_metrics", f"""WITH {SALES_SQL}
SELECT customer, sum(amount) AS total, count(*) AS count, avg(amount) AS mean FROM sales
WHERE customer IS NOT NULL GROUP BY customer ORDER BY total DESC, customer LIMIT 50""")
def d06_entity_metrics(spark, sf):
    return agg.entity_metrics(sales(Tables(spark, sf)), "customer", "amount", 50)


@query("d07_distinct_counts", """SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey,
  count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem""")
def d07_distinct_counts(spark, sf):
    return agg.distinct_counts(Tables(spark, sf).lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@query("d08_time_bucket_sum", """SELECT date_trunc('week', o_orderdate) AS period, sum(o_totalprice) AS total
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def d08_time_bucket_sum(spark, sf):
    return agg.time_bucket_sum(Tables(spark, sf).orders, "o_orderdate", "o_totalprice", "W")


@query("d09_resample_filled_daily", """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS v
  FROM events WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM d GROUP BY ALL),
cal AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS period FROM s)
SELECT cal.event_type, cal.period, coalesce(d.v, 0) AS value
FROM cal LEFT JOIN d ON cal.event_type = d.event_type AND cal.period = d.day""")
def d09_resample_filled_daily(spark, sf):
    return agg.resample_filled(Tables(spark, sf).events, "ts", "value", by=["event_type"])


@query("d09b_resample_filled_monthly", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS v
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL),
cal AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS period FROM m)
SELECT cal.period, coalesce(m.v, 0) AS value FROM cal LEFT JOIN m ON cal.period = m.month""")
def d09b_resample_filled_monthly(spark, sf):
    return agg.resample_filled(Tables(spark, sf).orders, "o_orderdate", "o_totalprice")


@query("d10_monthly_revenue_customers", f"""WITH {SALES_SQL}
SELECT date_trunc('month', date) AS month, sum(amount) AS revenue, count(DISTINCT customer) AS active_customers
FROM sales WHERE date IS NOT NULL GROUP BY ALL""")
def d10_monthly_revenue_customers(spark, sf):
    return agg.monthly_revenue_customers(sales(Tables(spark, sf)), "date", "amount", "customer")


@query("d11_pivot", """SELECT o_orderpriority,
  coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F",
  coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O",
  coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P"
FROM orders GROUP BY o_orderpriority""")
def d11_pivot(spark, sf):
    return agg.pivot_table(Tables(spark, sf).orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice",
                           "sum", ["F", "O", "P"])


@query("d12_crosstab", f"""WITH {SALES_SQL}
SELECT segment, priority, count(*) AS value FROM sales
WHERE segment IS NOT NULL AND priority IS NOT NULL GROUP BY ALL""")
def d12_crosstab(spark, sf):
    return agg.crosstab(sales(Tables(spark, sf)), "segment", "priority")


@query("d12b_crosstab_top", """WITH b AS (SELECT * FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag IS NOT NULL),
tp AS (SELECT l_partkey FROM b GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 5),
b2 AS (SELECT * FROM b WHERE l_partkey IN (SELECT l_partkey FROM tp)),
tf AS (SELECT l_returnflag FROM b2 GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 5)
SELECT l_partkey, l_returnflag, sum(l_quantity) AS value FROM b2
WHERE l_returnflag IN (SELECT l_returnflag FROM tf) GROUP BY ALL""")
def d12b_crosstab_top(spark, sf):
    return agg.crosstab(Tables(spark, sf).lineitem, "l_partkey", "l_returnflag", value="l_quantity", top=5)


@query("d13_melt", """SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def d13_melt(spark, sf):
    return agg.melt(Tables(spark, sf).part, ["p_partkey"], ["p_size", "p_retailprice"])


@query("d14_value_counts", """SELECT o_orderpriority, count(*) AS count,
  count(*) / (SELECT count(o_orderpriority) FROM orders) AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL""")
def d14_value_counts(spark, sf):
    return agg.value_counts(Tables(spark, sf).orders, "o_orderpriority")


@query("d15_mode", """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem
  WHERE l_quantity IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS rk FROM c)
SELECT l_returnflag, l_quantity AS mode, n AS mode_count FROM r WHERE rk = 1""")
def d15_mode(spark, sf):
    return agg.mode(Tables(spark, sf).lineitem, "l_quantity", by=["l_returnflag"])


_PCT_SQL = ", ".join(f"quantile_cont(l_extendedprice, {p}) AS p{int(round(p * 100)):02d}" for p in agg.PERCENTILES)


@query("d16_percentiles_shape", f"""SELECT l_returnflag, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean,
  stddev_samp(l_extendedprice) AS std, skewness(l_extendedprice) AS skew, kurtosis(l_extendedprice) AS kurtosis,
  {_PCT_SQL},
  CASE WHEN abs(skewness(l_extendedprice)) < 0.5 THEN 'normal'
       WHEN skewness(l_extendedprice) > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag""")
def d16_percentiles_shape(spark, sf):
    return agg.percentiles(Tables(spark, sf).lineitem, "l_extendedprice", by=["l_returnflag"])


@query("d17_five_numbers", """SELECT o_orderstatus, quantile_cont(o_totalprice, 0.0) AS min,
  quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
  quantile_cont(o_totalprice, 0.75) AS q3, quantile_cont(o_totalprice, 1.0) AS max
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_orderstatus""")
def d17_five_numbers(spark, sf):
    return agg.five_numbers(Tables(spark, sf).orders, "o_totalprice", by=["o_orderstatus"])


@query("d18_variance_pack", """WITH s AS (SELECT avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std,
  var_samp(l_extendedprice) AS var, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT s.*, std / abs(mean) * 100 AS cv_pct, q3 - q1 AS iqr, max - min AS range,
  (SELECT count(*) FROM lineitem WHERE l_extendedprice < s.q1 - 1.5 * (s.q3 - s.q1)
      OR l_extendedprice > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers,
  (SELECT count(*) FROM lineitem WHERE l_extendedprice < s.q1 - 1.5 * (s.q3 - s.q1)
      OR l_extendedprice > s.q3 + 1.5 * (s.q3 - s.q1)) * 100.0 / n AS outlier_pct
FROM s""")
def d18_variance_pack(spark, sf):
    return agg.variance_pack(Tables(spark, sf).lineitem, "l_extendedprice")


@query("d19_histogram", """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin
  FROM orders, s WHERE o_totalprice IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
bins AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS bin)
SELECT bins.bin, lo + bins.bin * ((hi - lo) / 10) AS bin_start, lo + (bins.bin + 1) * ((hi - lo) / 10) AS bin_end,
  coalesce(c.count, 0) AS count FROM bins CROSS JOIN s LEFT JOIN c ON bins.bin = c.bin""")
def d19_histogram(spark, sf):
    return agg.histogram(Tables(spark, sf).orders, "o_totalprice", bins=10)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
D20_SQL = "\nUNION ALL\n".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem"
                               for a, b in _CORR_PAIRS)


@query("d20_correlation_matrix", D20_SQL)
def d20_correlation_matrix(spark, sf):
    return agg.correlation_matrix(Tables(spark, sf).lineitem, _CORR_COLS)


@query("d21_correlation_pairs", f"""SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
  ELSE 'weak' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({D20_SQL}) m WHERE abs(r) >= 0.3""")
def d21_correlation_pairs(spark, sf):
    return agg.correlation_pairs(Tables(spark, sf).lineitem, _CORR_COLS, threshold=0.3)


@query("d22_concentration", f"""WITH {SALES_SQL},
t AS (SELECT customer, sum(amount) AS tot FROM sales WHERE customer IS NOT NULL GROUP BY customer),
r AS (SELECT customer, tot * 100 / (SELECT sum(tot) FROM t) AS share,
  row_number() OVER (ORDER BY tot DESC, customer) AS rk FROM t),
a AS (SELECT sum(share) FILTER (WHERE rk <= 4) AS cr4, sum(share) FILTER (WHERE rk <= 8) AS cr8,
  sum(share * share) FILTER (WHERE rk <= 50) AS hhi, max(customer) FILTER (WHERE rk = 1) AS leader,
  max(share) FILTER (WHERE rk = 1) AS leader_share FROM r)
SELECT *, CASE WHEN hhi < 1500 THEN 'competitive' WHEN hhi < 2500 THEN 'moderate' ELSE 'concentrated' END AS structure FROM a""")
def d22_concentration(spark, sf):
    return agg.concentration(sales(Tables(spark, sf)), "customer", "amount", hhi_top=50)  # as the reference and the SQL define it


@query("d23_category_concentration", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS rk FROM c),
a AS (SELECT sum(n) FILTER (WHERE rk <= 1) * 100.0 / (SELECT sum(n) FROM c) AS top1_pct,
  sum(n) FILTER (WHERE rk <= 3) * 100.0 / (SELECT sum(n) FROM c) AS top3_pct,
  sum(n) FILTER (WHERE rk <= 5) * 100.0 / (SELECT sum(n) FROM c) AS top5_pct FROM r)
SELECT *, CASE WHEN top1_pct > 50 THEN 'dominated' WHEN top3_pct > 80 THEN 'concentrated'
  ELSE 'distributed' END AS concentration FROM a""")
def d23_category_concentration(spark, sf):
    return agg.category_concentration(Tables(spark, sf).orders, "o_orderpriority")


@query("d24_balance_entropy", """WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY ALL),
a AS (SELECT max(n) AS max_count, min(n) AS min_count, count(*) AS k, var_samp(n) AS count_variance,
  quantile_cont(n, 0.25) AS count_q1, quantile_cont(n, 0.5) AS count_median, quantile_cont(n, 0.75) AS count_q3,
  -sum(n / (SELECT sum(n) FROM c) * log2(n / (SELECT sum(n) FROM c))) AS entropy FROM c)
SELECT *, max_count / min_count AS ratio,
  CASE WHEN max_count / min_count < 1.5 THEN 'balanced' WHEN max_count / min_count < 3 THEN 'moderate'
  ELSE 'imbalanced' END AS balance, entropy / log2(k) AS entropy_ratio FROM a""")
def d24_balance_entropy(spark, sf):
    return agg.balance_entropy(Tables(spark, sf).part, "p_brand")


@query("d25_group_range", """SELECT p_brand, min(p_retailprice) AS min, max(p_retailprice) AS max,
  avg(p_retailprice) AS mean FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def d25_group_range(spark, sf):
    return agg.group_range(Tables(spark, sf).part, "p_brand", "p_retailprice")


@query("d26_comparison_matrix", f"""WITH {SALES_SQL},
long AS (SELECT 'segment' AS dimension, segment AS category, 'amount' AS metric, amount AS x FROM sales
  UNION ALL SELECT 'segment', segment, 'quantity', quantity FROM sales
  UNION ALL SELECT 'priority', priority, 'amount', amount FROM sales
  UNION ALL SELECT 'priority', priority, 'quantity', quantity FROM sales)
SELECT dimension, category, metric, coalesce(sum(x), 0) AS sum, avg(x) AS mean, count(x) AS count
FROM long WHERE category IS NOT NULL GROUP BY ALL""")
def d26_comparison_matrix(spark, sf):
    return agg.comparison_matrix(sales(Tables(spark, sf)), ["segment", "priority"], ["amount", "quantity"])


@query("d27_currency_breakdown", f"""WITH {CUSTOMER_CURRENCY_SQL}, fx(currency, usd_rate) AS {FX_VALUES_SQL},
g AS (SELECT currency, sum(c_acctbal) AS total, count(*) AS count FROM cc GROUP BY currency),
u AS (SELECT g.currency, total, count, total * coalesce(usd_rate, 1.0) AS usd_total FROM g LEFT JOIN fx USING (currency))
SELECT currency, total, count, usd_total, usd_total / (SELECT sum(usd_total) FROM u) * 100 AS share_pct,
  currency = (SELECT arg_max(currency, usd_total) FROM u) AS is_primary FROM u""")
def d27_currency_breakdown(spark, sf):
    t = Tables(spark, sf)
    return agg.currency_breakdown(customer_currency(t), "c_acctbal", "currency", agg.fx_rates_table(spark))


@query("d28_cube", """SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total, count(*) AS count,
  grouping(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def d28_cube(spark, sf):
    return agg.grouping_sets(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "cube")


@query("d28b_rollup", """SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total, count(*) AS count,
  grouping(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def d28b_rollup(spark, sf):
    return agg.grouping_sets(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "rollup")


@query("d29_source_summary", """SELECT 'orders_' || o_orderstatus AS _source_file, count(*) AS rows,
  sum(o_totalprice) AS total FROM orders GROUP BY ALL""")
def d29_source_summary(spark, sf):
    from kestrel.sources.files import union_sources
    o = Tables(spark, sf).orders
    u = union_sources({f"orders_{s}": o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")})
    return agg.source_summary(u, "_source_file", "o_totalprice")


@query("d30_storage_used", "SELECT user_id, coalesce(sum(value), 0) AS bytes_used FROM events GROUP BY user_id")
def d30_storage_used(spark, sf):
    return agg.storage_used(Tables(spark, sf).events, "user_id", "value")

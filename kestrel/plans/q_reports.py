"""Registered schema, dashboard and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import overview, reports
from kestrel.operators import schema as sch
from kestrel.operators.aggregate import fx_rates_table
from kestrel.plans.common import SALES_ORDER, SALES_ORDER_SQL, SALES_SQL, sales
from kestrel.plans.q_aggregate import CODES, CODES_SQL, FX_VALUES_SQL
from kestrel.plans.distributed import written
from kestrel.plans.registry import query
from kestrel.session import Tables


def cells(section: str, item: str, measures: str, source: str) -> str:
    """SQL of tidy rows: the measures are column names of ``source``."""
    names = measures.split()
    return (f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, unnest([{', '.join(repr(n) for n in names)}]) AS measure, "
            f"unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS value FROM {source}")


def tidy(ctes: str, *parts: str) -> str:
    return f"WITH {ctes}\nSELECT * FROM (\n" + "\nUNION ALL ".join(f"({p})" for p in parts) + "\n) WHERE value IS NOT NULL"


# ------------------------------------------------------------------ J3

_ORDERS = [("o_orderkey", "bigint", "identifier", 1), ("o_custkey", "bigint", "identifier", 1), ("o_orderstatus", "string", "categorical", 0),
           ("o_totalprice", "double", "monetary", 1), ("o_orderdate", "timestamp", "temporal", 0),
           ("o_orderpriority", "string", "categorical", 0)]
_J3 = "\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS category, count(*) - count({c}) AS missing, "
    f"count(DISTINCT {c}) AS \"distinct\", " + (", ".join(f"{fn}({c})::DOUBLE" + (f" AS {n}" if n else "") for fn, n in (
        ("avg", "mean"), ("stddev_samp", "std"), ("min", "\"min\""), ("max", "\"max\""))) if num else
        "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS \"min\", NULL::DOUBLE AS \"max\"") +
    f", {'TRUE' if c == 'o_totalprice' else f'count(DISTINCT {c}) > 10' if num else 'FALSE'} AS is_metric, "
    f"{'FALSE' if c == 'o_orderdate' else f'count(DISTINCT {c}) >= 2' if t == 'string' else f'count(DISTINCT {c}) BETWEEN 2 AND 50'} AS is_dimension, "
    f"{'TRUE' if c == 'o_orderdate' else 'FALSE'} AS is_time FROM orders" for i, (c, t, k, num) in enumerate(_ORDERS))


@query("j03_schema_columns", _J3)
def j03_schema_columns(spark, sf):
    out = sch.schema_columns(Tables(spark, sf).orders)
    return out.withColumn("dtype", F.regexp_replace("dtype", "timestamp_ntz", "timestamp"))


@query("j03b_schema_summary", """WITH n AS (SELECT count(*) AS r, 0 """ + "".join(f"+ count(*) - count({c[0]}) " for c in _ORDERS) + """AS gone FROM orders)
SELECT r AS rows, 6 AS columns, gone AS missing, r - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicates,
  1 - gone / (r * 6.0) AS completeness, 'e-commerce' AS domain, 1.0 AS domain_confidence, 'o_orderdate' AS time_column FROM n""")
def j03b_schema_summary(spark, sf):
    return sch.schema_summary(Tables(spark, sf).orders)


# ------------------------------------------------------------------ K14

_GRADED = """{n}t AS (SELECT {e} AS e, sum(amount) AS total, count(*) AS count FROM sales WHERE {e} IS NOT NULL GROUP BY 1),
{n}r AS (SELECT *, row_number() OVER (ORDER BY total DESC, e) AS rank, total / (SELECT sum(total) FROM {n}t) * 100 AS share_pct,
  sum(total) OVER (ORDER BY total DESC, e ROWS UNBOUNDED PRECEDING) / (SELECT sum(total) FROM {n}t) * 100 AS cumulative_pct FROM {n}t),
{n} AS (SELECT *, CASE WHEN cumulative_pct <= 70 THEN 'A' WHEN cumulative_pct <= 90 THEN 'B' ELSE 'C' END AS grade,
  CASE WHEN cumulative_pct <= 70 THEN 1 WHEN cumulative_pct <= 90 THEN 2 ELSE 3 END AS grade_no FROM {n}r)"""
_K14 = f"""{SALES_SQL},
{_GRADED.format(n='p', e='product')},
{_GRADED.format(n='c', e='customer')},
tier AS (SELECT *, total / count AS avg_order, CASE WHEN pct <= 15 AND count >= 2 THEN 'Champions' WHEN pct <= 35 THEN 'Loyal'
  WHEN pct <= 60 THEN 'Potential' WHEN pct <= 85 THEN 'At Risk' ELSE 'Needs Attention' END AS tier
  FROM (SELECT *, (rank - 1) * 100.0 / (SELECT count(*) FROM c) AS pct FROM c)),
tiers AS (SELECT tier, count(*) AS customers, sum(total) AS revenue, count(*) * 100.0 / (SELECT count(*) FROM c) AS customer_pct
  FROM tier GROUP BY tier),
m AS (SELECT date_trunc('month', date) AS month, sum(amount) AS revenue, count(*) AS orders, count(DISTINCT customer) AS customers,
  sum(amount) / count(*) AS avg_order FROM sales GROUP BY 1),
g AS (SELECT month, {', '.join(f"({x} - lag({x}) OVER w) / abs(lag({x}) OVER w) * 100 AS {x}" for x in ('revenue', 'orders', 'customers', 'avg_order'))}
  FROM m WINDOW w AS (ORDER BY month) QUALIFY month = max(month) OVER ()),
t AS (SELECT sum(amount) AS revenue, count(*) AS orders, sum(amount) / count(*) AS avg_order, count(DISTINCT customer) AS customers,
  count(DISTINCT product) AS products FROM sales)"""


def _graded_parts(n: str, name: str) -> list[str]:
    return [cells(f"abc_{name}", "e", "total share_pct cumulative_pct rank grade_no", n),
            cells(f"abc_{name}_summary", "grade", "entities revenue",
                  f"(SELECT grade, count(*) AS entities, sum(total) AS revenue FROM {n} GROUP BY grade)")]


@query("k14_dashboard_stats", tidy(
    _K14, cells("totals", "'all'", "revenue orders avg_order customers products", "t"), *_graded_parts("p", "product"),
    *_graded_parts("c", "customer"), cells("tier_customer", "tier || '/' || e", "total count avg_order rank", "tier"),
    cells("tier_summary", "tier", "customers revenue customer_pct", "tiers"),
    cells("timeline", "strftime(month, '%Y-%m')", "revenue orders customers avg_order", "m"),
    cells("growth_pct", "'last_month'", "revenue orders customers avg_order", "g"),
    cells("findings", "'customers'", "top3_customers_pct a_customers a_customers_pct",
          "(SELECT sum(share_pct) FILTER (rank <= 3) AS top3_customers_pct, count(*) FILTER (grade = 'A') AS a_customers, "
          "count(*) FILTER (grade = 'A') * 100.0 / count(*) AS a_customers_pct FROM c)"),
    cells("findings", "'tiers'", "at_risk_customers at_risk_revenue",
          "(SELECT customers AS at_risk_customers, revenue AS at_risk_revenue FROM tiers WHERE tier = 'At Risk')")))
def k14_dashboard_stats(spark, sf):
    return reports.dashboard_stats(sales(Tables(spark, sf)), "date", "amount", "customer", "product")


# ------------------------------------------------------------------ K15


def _overview_table(t: Tables):
    return sales(t).select("segment", "priority", "returnflag", "date", "amount", "quantity")


def _top_sql(section: str, dim: str) -> str:
    return cells(section, "e", "total rank", f"(SELECT *, row_number() OVER (ORDER BY total DESC, e) AS rank FROM "
                 f"(SELECT {dim} AS e, avg(amount) AS total FROM sales WHERE {dim} IS NOT NULL GROUP BY 1) QUALIFY rank <= 5)")


_K15 = f"""{SALES_SQL},
mid AS (SELECT date AS mid FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM sales) WHERE i = (SELECT count(*) // 2 FROM sales)),
h AS (SELECT (avg(amount) FILTER (date >= mid) / avg(amount) FILTER (date < mid) - 1) * 100 AS a,
  (avg(quantity) FILTER (date >= mid) / avg(quantity) FILTER (date < mid) - 1) * 100 AS q FROM sales, mid),
t AS (SELECT segment, strftime(date, '%Y-%m') AS month, avg(amount) AS mean FROM sales GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY strftime(date, '%Y-%m') DESC) <= 20),
top6 AS (SELECT segment, amount, row_number() OVER (ORDER BY amount DESC, segment) AS rank FROM sales QUALIFY rank <= 6)"""


@query("k15_unified_overview", tidy(
    _K15, cells("kpis", "'Total Amount'", "value", "(SELECT sum(amount) AS value FROM sales)"),
    cells("kpis", "'Total Quantity'", "value", "(SELECT sum(quantity) AS value FROM sales)"),
    cells("kpis", "'Total Records'", "value", "(SELECT count(*) AS value FROM sales)"),
    cells("kpis", "'Segments'", "value", "(SELECT count(DISTINCT segment) AS value FROM sales)"),
    cells("kpis", "'Total Amount'", "change_pct", "(SELECT a AS change_pct FROM h)"),
    cells("kpis", "'Total Quantity'", "change_pct", "(SELECT q AS change_pct FROM h)"),
    cells("trend", "segment || '/' || month", "mean", "t"), _top_sql("comparison", "segment"), _top_sql("top_segment", "segment"),
    _top_sql("top_priority", "priority"), cells("ranked", "rank || '. ' || segment", "amount", "top6"),
    cells("spread", "'amount'", "min q1 median q3 max mean", "(SELECT min(amount) AS min, quantile_cont(amount, 0.25) AS q1, "
          "median(amount) AS median, quantile_cont(amount, 0.75) AS q3, max(amount) AS max, avg(amount) AS mean FROM sales)"),
    cells("distribution", "e", "total rank", "(SELECT *, row_number() OVER (ORDER BY total DESC, e) AS rank FROM "
          "(SELECT priority AS e, count(*) AS total FROM sales GROUP BY 1) QUALIFY rank <= 5)"),
    cells("crosstab", "segment || '/' || priority", "count", "(SELECT segment, priority, count(*) AS count FROM sales GROUP BY ALL)"),
    "SELECT 'slicers' AS section, 'date' AS item, unnest(['from', 'to']) AS measure, unnest([epoch(min(date)), epoch(max(date))]) AS value FROM sales",
    *[cells("slicers", f"'{d}=' || {d}", "n", f"(SELECT {d}, count(*) AS n FROM sales GROUP BY 1)") for d in ("segment", "priority", "returnflag")]))
def k15_unified_overview(spark, sf):
    return overview.unified_overview(written(_overview_table(Tables(spark, sf)), "overview-rows"))


def _roles_sql(i: int, c: str, role: str) -> str:
    stats = f"var_samp({c}), sum({c})::DOUBLE, avg({c})" if role == "metric" else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    return (f"SELECT {i} AS position, '{c}' AS \"column\", '{role}' AS role, count(DISTINCT {c}) AS cardinality, "
            f"(count(*) - count({c})) / count(*) AS null_ratio, {stats} FROM sales")


@query("k15b_overview_roles", f"WITH {SALES_SQL} SELECT * FROM (" + " UNION ALL ".join(
    _roles_sql(i, c, r) for i, (c, r) in enumerate((("segment", "dimension"), ("priority", "dimension"), ("returnflag", "dimension"),
                                                    ("date", "time"), ("amount", "metric"), ("quantity", "metric")))) +
    ") AS u(position, \"column\", role, cardinality, null_ratio, variance, total, mean)")
def k15b_overview_roles(spark, sf):
    return overview.overview_roles(_overview_table(Tables(spark, sf)))


# ------------------------------------------------------------------ K16, K17, K19


def _list_sql(section: str, entity: str, source: str, k: int, measures: str = "total rank") -> str:
    return cells(section, "e", measures, f"(SELECT e, total, orders, total / (SELECT sum(amount) FROM sales) * 100 AS share_pct, "
                 f"row_number() OVER (ORDER BY total DESC, CAST(e AS VARCHAR)) AS rank FROM (SELECT {entity} AS e, sum(amount) AS total, "
                 f"count(*) AS orders FROM {source} WHERE {entity} IS NOT NULL GROUP BY 1) QUALIFY rank <= {k})")


def _with_currency(t: Tables):
    """Sales with a currency derived from the customer's nation (test mapping)."""
    codes = t.customer.select(F.col("c_name").alias("customer"), F.element_at(F.array(*[F.lit(c) for c in CODES]), (
        F.col("c_nationkey") % len(CODES) + 1).cast("int")).alias("currency"))
    return sales(t).join(codes, "customer", "left")


def _k16(days: int, top: int) -> str:
    ctes = f"""{SALES_SQL},
ref AS (SELECT max(date) AS ref FROM sales),
cur AS (SELECT sales.*, {CODES_SQL}[c_nationkey % {len(CODES)} + 1] AS currency FROM sales JOIN customer ON c_name = customer, ref
  WHERE date >= ref - INTERVAL {days} DAY),
prev AS (SELECT coalesce(sum(amount), 0) AS before FROM sales, ref WHERE date < ref - INTERVAL {days} DAY AND date >= ref - INTERVAL {2 * days} DAY),
t AS (SELECT sum(amount) AS revenue, count(*) AS orders, avg(amount) AS avg_order, count(DISTINCT customer) AS customers,
  count(DISTINCT product) AS products, CASE WHEN any_value(before) > 0 THEN (sum(amount) - any_value(before)) / any_value(before) * 100
  ELSE 0 END AS growth_pct FROM cur, prev),
fx(currency, usd_rate) AS {FX_VALUES_SQL},
f AS (SELECT currency, sum(amount) AS total, sum(amount) * any_value(coalesce(usd_rate, 1.0)) AS usd_total FROM cur LEFT JOIN fx USING (currency) GROUP BY 1)"""
    return tidy(ctes, cells("totals", "'period'", "revenue orders avg_order customers products growth_pct", "t"),
                cells("weeks", "strftime(week, '%Y-%m-%d')", "revenue", "(SELECT date_trunc('week', date) + INTERVAL 6 DAY AS week, "
                      "sum(amount) AS revenue FROM cur GROUP BY 1)"),
                _list_sql("customers", "customer", "cur", top), _list_sql("products", "product", "cur", top),
                cells("currencies", "currency", "total usd_total share_pct",
                      "(SELECT *, usd_total / (SELECT sum(usd_total) FROM f) * 100 AS share_pct FROM f)"),
                cells("currencies", "'all'", "usd_total", "(SELECT sum(usd_total) AS usd_total FROM f)"))


@query("k16b_weekly_summary", _k16(7, 5))
def k16b_weekly_summary(spark, sf):
    t = Tables(spark, sf)
    return reports.period_summary(_with_currency(t), "date", "amount", "customer", "product", 7, 5, "currency", fx_rates_table(spark))


@query("k16c_monthly_summary", _k16(30, 10))
def k16c_monthly_summary(spark, sf):
    t = Tables(spark, sf)
    return reports.period_summary(_with_currency(t), "date", "amount", "customer", "product", 30, 10, "currency", fx_rates_table(spark))


@query("k17b_enterprise_summary", tidy(
    SALES_SQL, cells("totals", "'all'", "revenue orders avg_order customers products",
                     "(SELECT sum(amount) AS revenue, count(*) AS orders, sum(amount) / count(*) AS avg_order, "
                     "count(DISTINCT customer) AS customers, count(DISTINCT product) AS products FROM sales)"),
    _list_sql("customers", "customer", "sales", 5, "total orders share_pct rank"),
    _list_sql("products", "product", "sales", 5, "total orders share_pct rank"),
    cells("concentration", "'customers'", "top_customers_pct", "(SELECT sum(s) / (SELECT sum(amount) FROM sales) * 100 AS top_customers_pct "
          "FROM (SELECT sum(amount) AS s FROM sales WHERE customer IS NOT NULL GROUP BY customer ORDER BY s DESC, customer LIMIT 5))")))
def k17b_enterprise_summary(spark, sf):
    return reports.enterprise_report(sales(Tables(spark, sf)), "amount", "customer", "product")


def _text_list(chunk: str, entity: str, k: int, way: str, noun: str) -> str:
    return (f"SELECT '{chunk}' AS chunk, rank AS line, rank || '. ' || e || ': ' || format('{{:,.2f}}', total) || ' (' || n || ' {noun})' AS text "
            f"FROM (SELECT CAST({entity} AS VARCHAR) AS e, sum(amount) AS total, count(*) AS n, "
            f"row_number() OVER (ORDER BY sum(amount) {way}, CAST({entity} AS VARCHAR)) AS rank FROM sales WHERE {entity} IS NOT NULL "
            f"GROUP BY {entity} QUALIFY rank <= {k})")


@query("k19b_summary_texts", f"""WITH {SALES_SQL}
SELECT 'summary' AS chunk, unnest([1, 2, 3, 4, 5]) AS line, unnest(['Total Records: ' || count(*), 'Total Revenue: ' || format('{{:,.2f}}', sum(amount)),
  'Average Order Value: ' || format('{{:,.2f}}', avg(amount)), 'Unique Customers: ' || count(DISTINCT customer),
  'Unique Products: ' || count(DISTINCT product)]) AS text FROM sales
UNION ALL {_text_list('top_customers', 'customer', 20, 'DESC', 'orders')}
UNION ALL {_text_list('bottom_customers', 'customer', 20, 'ASC', 'orders')}
UNION ALL {_text_list('top_products', 'product', 15, 'DESC', 'sales')}
UNION ALL {_text_list('bottom_products', 'product', 10, 'ASC', 'sales')}
UNION ALL SELECT 'months', row_number() OVER (ORDER BY month), strftime(month, '%Y-%m') || ': ' || format('{{:,.2f}}', total) || ' (' || n || ' orders)'
  FROM (SELECT date_trunc('month', date) AS month, sum(amount) AS total, count(*) AS n FROM sales GROUP BY 1)""")
def k19b_summary_texts(spark, sf):
    return reports.summary_texts(sales(Tables(spark, sf)), "date", "amount", "customer", "product")


# ------------------------------------------------------------------ K18

_NUMS = ("amount", "quantity", "l_linenumber")
_TEXTS = ("segment", "priority", "returnflag")


def _report_table(t: Tables):
    return sales(t).select(*_NUMS, *_TEXTS, "date", "invoice", "product", "l_suppkey")


@query("k18_metrics_report", tidy(
    f"""{SALES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY {SALES_ORDER_SQL}) <= (SELECT count(*) // 2 FROM sales) AS early FROM sales),
b AS (SELECT min(amount) AS lo, max(amount) AS hi, (max(amount) - min(amount)) / 10 AS w FROM sales),
n AS (SELECT least(floor((amount - lo) / w), 9) AS bin, count(*) AS count FROM sales, b GROUP BY 1),
h AS (SELECT i AS bin, lo + i * w AS bin_start, lo + (i + 1) * w AS bin_end, coalesce(count, 0) AS count
  FROM b, (SELECT unnest(range(10)) AS i) LEFT JOIN n ON n.bin = i)""",
    *[cells("overview", f"'{c}'", "mean std", f"(SELECT avg({c}) AS mean, stddev_samp({c}) AS std FROM sales)")
      for c in (*_NUMS, "invoice", "product", "l_suppkey")],
    *[cells("half_change_pct", f"'{c}'", "change", f"(SELECT (avg({c}) FILTER (NOT early) / avg({c}) FILTER (early) - 1) * 100 AS change FROM r)")
      for c in (*_NUMS, "invoice", "product", "l_suppkey")],
    cells("histogram_amount", "bin", "bin_start bin_end count", "h")))
def k18_metrics_report(spark, sf):
    return reports.metrics_report(_report_table(Tables(spark, sf)), SALES_ORDER)


@query("k18b_breakdown_report", tidy(
    SALES_SQL + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM sales WHERE {c} IS NOT NULL GROUP BY 2"
                                                for c in _TEXTS) + ")",
    cells("columns", "c", "\"distinct\" present", "(SELECT c, count(*) AS \"distinct\", sum(n) AS present FROM v GROUP BY c)").replace(
        "'\"distinct\"'", "'distinct'"),
    cells("values", "c || '=' || v", "n rank", "(SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rank FROM v QUALIFY rank <= 8)"),
    cells("mean_amount_by_segment", "g", "mean", "(SELECT segment AS g, avg(amount) AS mean FROM sales GROUP BY 1 ORDER BY mean DESC, g LIMIT 10)")))
def k18b_breakdown_report(spark, sf):
    return reports.breakdown_report(_report_table(Tables(spark, sf)))


_CUST = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("k18c_summary_report", tidy(
    "n AS (SELECT count(*) AS rows, 0" + "".join(f" + count(*) - count({c})" for c in _CUST) + " AS missing, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicates FROM customer), "
    "s AS (SELECT *, missing / (rows * 5) * 100 AS missing_pct, 100 - missing / (rows * 5) * 100 AS completeness_pct, "
    "greatest(0.0, 100 - missing / (rows * 5) * 200 - duplicates / rows * 50) AS quality_score, 5 AS columns, 3 AS numeric_columns, "
    "2 AS text_columns, 0 AS time_columns FROM n)",
    cells("overview", "'table'", "rows missing duplicates missing_pct completeness_pct quality_score columns numeric_columns "
          "text_columns time_columns", "s"),
    *[cells("statistics", f"'{c}'", "mean min max", f"(SELECT avg({c}) AS mean, min({c}) AS min, max({c}) AS max FROM customer)")
      for c in ("c_custkey", "c_nationkey", "c_acctbal")],
    *[cells("missing", f"'{c}'", "missing", f"(SELECT count(*) - count({c}) AS missing FROM customer)") for c in _CUST]))
def k18c_summary_report(spark, sf):
    return reports.summary_report(Tables(spark, sf).customer)


_EV = ("value", "event_id", "user_id")


@query("k18d_anomaly_report", tidy(
    "z AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) FILTER (s > 0 AND abs(({c} - a) / s) > 3) AS anomalies FROM events, "
        f"(SELECT avg({c}) AS a, stddev_samp({c}) AS s FROM events)" for c in _EV) + "), "
    "q AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT min(value) AS min, "
    "quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max FROM events)), "
    "o AS (SELECT count(*) FILTER (value < lower OR value > upper) AS outside FROM events, q)",
    cells("z_score", "c", "anomalies", "z"), cells("z_score", "'all'", "anomalies", "(SELECT sum(anomalies) AS anomalies FROM z)"),
    cells("box", "'value'", "min q1 median q3 max iqr lower upper", "q"), cells("box", "'value'", "outside", "o")))
def k18d_anomaly_report(spark, sf):
    return reports.anomaly_report(Tables(spark, sf).events.select("value", "event_id", "user_id"))

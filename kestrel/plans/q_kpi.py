"""Registered business-analytics and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import kpi, series
from kestrel.plans.common import SALES_ORDER, SALES_SQL, sales
from kestrel.plans.registry import query
from kestrel.session import Tables


@query("k01_cohort_retention", f"""WITH {SALES_SQL},
b AS (SELECT * FROM sales WHERE customer IS NOT NULL AND date IS NOT NULL),
f AS (SELECT customer, min(date) AS first FROM b GROUP BY customer),
j AS (SELECT b.customer, date_trunc('month', f.first) AS cohort,
  datediff('month', date_trunc('month', f.first), date_trunc('month', b.date)) AS period_offset, b.amount FROM b JOIN f USING (customer)),
g AS (SELECT cohort, period_offset, count(DISTINCT customer) AS active_users, sum(amount) AS total_value,
  avg(amount) AS avg_value FROM j GROUP BY ALL),
z AS (SELECT cohort, active_users AS cohort_size FROM g WHERE period_offset = 0)
SELECT g.*, z.cohort_size, g.active_users * 100.0 / z.cohort_size AS retention_pct FROM g JOIN z USING (cohort)""")
def k01_cohort_retention(spark, sf):
    return kpi.cohort_retention(sales(Tables(spark, sf)), "date", "customer", "amount", "M")


@query("k01b_cohort_matrix_weekly_events")
def k01b_cohort_matrix_weekly_events(spark, sf):
    ev = Tables(spark, sf).events
    return kpi.cohort_matrix(kpi.cohort_retention(ev, "ts", "user_id", "value", "W"), 4)


_K2_F = ["l_quantity", "l_discount", "l_tax"]


@query("k02_root_cause_drivers", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'driver' AS kind, '{c}' AS factor, corr({c}, l_extendedprice) AS impact, "
    f"least(abs(corr({c}, l_extendedprice)), 0.9) AS confidence FROM lineitem" for c in _K2_F) + ") WHERE abs(impact) > 0.3")
def k02_root_cause_drivers(spark, sf):
    return kpi.root_cause_drivers(Tables(spark, sf).lineitem, "l_extendedprice", _K2_F)


@query("k03_root_cause_periods", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS mean
  FROM orders GROUP BY ALL),
c AS (SELECT *, (mean - lag(mean) OVER (ORDER BY month)) / abs(lag(mean) OVER (ORDER BY month)) * 100 AS change_pct FROM m)
SELECT 'period' AS kind, strftime(month, '%Y-%m') AS factor, change_pct / 100 AS impact, 0.7 AS confidence
FROM c WHERE abs(change_pct) > 10""")
def k03_root_cause_periods(spark, sf):
    return kpi.root_cause_periods(Tables(spark, sf).orders, "o_orderdate", "o_totalprice")


@query("k04_root_cause_segments", f"""WITH {SALES_SQL},
o AS (SELECT avg(amount) AS overall FROM sales),
l AS (SELECT 'segment' AS col, segment AS category, amount AS x FROM sales UNION ALL
  SELECT 'priority', priority, amount FROM sales UNION ALL SELECT 'returnflag', returnflag, amount FROM sales),
g AS (SELECT col, category, avg(x) AS mean, count(*) AS n FROM l WHERE category IS NOT NULL GROUP BY ALL),
i AS (SELECT 'segment' AS kind, col || '=' || category AS factor, (mean - overall) / overall AS impact,
  least(0.8, n / 50.0) AS confidence FROM g, o WHERE abs((mean - overall) / overall) > 0.01 AND n >= 5)
SELECT * FROM i ORDER BY abs(impact) DESC, factor LIMIT 10""")
def k04_root_cause_segments(spark, sf):
    return kpi.root_cause_segments(sales(Tables(spark, sf)), "amount", ["segment", "priority", "returnflag"],
                                   threshold=0.01)


@query("k05_root_cause_merged")
def k05_root_cause_merged(spark, sf):
    t = Tables(spark, sf)
    s = sales(t)
    parts = [kpi.root_cause_drivers(s, "amount", ["quantity"], 0.3),
             kpi.root_cause_periods(t.orders, "o_orderdate", "o_totalprice"),
             kpi.root_cause_segments(s, "amount", ["segment", "priority"], threshold=0.01, top=None)]
    return kpi.root_cause(parts)


@query("k06_trend_detection")
def k06_trend_detection(spark, sf):
    return kpi.trend_detection(Tables(spark, sf).orders, "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("k07_trend_anomalies", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3,
  avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, o_totalprice AS value, abs(o_totalprice - mu) / sd AS z,
  CASE WHEN o_totalprice > mu THEN 'high' ELSE 'low' END AS direction FROM orders, q
WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)
ORDER BY z DESC, o_orderkey LIMIT 5""")
def k07_trend_anomalies(spark, sf):
    return kpi.trend_anomalies(Tables(spark, sf).orders, "o_totalprice", "o_orderkey")


ALERT_RULES = [
    {"name": "revenue_floor", "metric": "revenue", "condition": "lt", "threshold": 1e12, "priority": "high"},
    {"name": "orders_drop", "metric": "orders", "condition": "drop_pct", "threshold": 5, "priority": "medium"},
    {"name": "revenue_swing", "metric": "revenue", "condition": "change_pct", "threshold": 1, "priority": "low"},
    {"name": "orders_ceiling", "metric": "orders", "condition": "gte", "threshold": 1e9, "priority": "low"},
]


def _monthly_kpis(t: Tables):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"))


@query("k08_threshold_alerts")
def k08_threshold_alerts(spark, sf):
    return kpi.threshold_alerts(_monthly_kpis(Tables(spark, sf)), ALERT_RULES, "month")


@query("k09_anomaly_alert", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY ALL),
s AS (SELECT avg(revenue) AS mu, stddev_pop(revenue) AS sd, arg_max(revenue, month) AS latest FROM m)
SELECT latest, mu, sd, (latest - mu) / sd AS z, CASE WHEN abs((latest - mu) / sd) > 3 THEN 'high'
  WHEN abs((latest - mu) / sd) > 2 THEN 'medium' END AS severity FROM s""")
def k09_anomaly_alert(spark, sf):
    return kpi.anomaly_alert(_monthly_kpis(Tables(spark, sf)), "revenue", "month")


@query("k10_decline_alert")
def k10_decline_alert(spark, sf):
    return kpi.decline_alert(_monthly_kpis(Tables(spark, sf)), "revenue", ["month"])


@query("k11_insight_rules")
def k11_insight_rules(spark, sf):
    s = sales(Tables(spark, sf))
    return kpi.insight_rules(kpi.business_metrics(s, "date", "amount", "customer", "product", "invoice"))


@query("k12_insight_scores")
def k12_insight_scores(spark, sf):
    s = sales(Tables(spark, sf))
    return kpi.insight_scores(kpi.insight_rules(kpi.business_metrics(s, "date", "amount", "customer", "product", "invoice")))


@query("k13_kpi_cards")
def k13_kpi_cards(spark, sf):
    return kpi.kpi_cards(sales(Tables(spark, sf)), "date", "amount", SALES_ORDER)


@query("k16_weekly_report")
def k16_weekly_report(spark, sf):
    return kpi.period_report(sales(Tables(spark, sf)), "date", "amount", "invoice", "customer", "product", 7)


@query("k17_enterprise_report", f"""WITH {SALES_SQL}
SELECT customer, sum(amount) AS total, count(DISTINCT invoice) AS orders,
  sum(amount) / (SELECT sum(amount) FROM sales) * 100 AS share_pct FROM sales WHERE customer IS NOT NULL
GROUP BY customer ORDER BY total DESC, customer LIMIT 5""")
def k17_enterprise_report(spark, sf):
    return kpi.entity_report(sales(Tables(spark, sf)), "customer", "amount", "invoice")


@query("k19_summary_text_rows", f"""WITH {SALES_SQL},
t AS (SELECT customer, sum(amount) AS total FROM sales WHERE customer IS NOT NULL GROUP BY customer
  ORDER BY total DESC, customer LIMIT 20)
SELECT row_number() OVER (ORDER BY total DESC, customer) AS rank,
  CAST(row_number() OVER (ORDER BY total DESC, customer) AS VARCHAR) || '. ' || customer || ': ' || format('{{:,.2f}}', total) AS text
FROM t""")
def k19_summary_text_rows(spark, sf):
    return kpi.summary_text_rows(sales(Tables(spark, sf)), "customer", "amount")


WHATIF = [{"name": "more_volume", "column": "quantity", "change": 0.1},
          {"name": "less_volume", "column": "quantity", "change": -0.1}]


@query("k20_what_if")
def k20_what_if(spark, sf):
    return kpi.what_if(sales(Tables(spark, sf)), "amount", ["quantity"], WHATIF)


@query("k21_elasticity", """SELECT c_mktsegment, sum(o_totalprice) AS baseline, 1 + (-1.2) * (-0.05) + 0.3 * 0.1 AS volume_factor,
  sum(o_totalprice) * (1 - 0.05) * (1 + (-1.2) * (-0.05) + 0.3 * 0.1) AS projected,
  ((1 - 0.05) * (1 + (-1.2) * (-0.05) + 0.3 * 0.1) - 1) * 100 AS change_pct
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def k21_elasticity(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return kpi.elasticity(j, "o_totalprice", price_change=-0.05, marketing_change=0.1, by=["c_mktsegment"])


# ------------------------------------------------------------------ L


def _monthly_series(t: Tables):
    return series.prepare(
        t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("revenue")),
        "month", "revenue")


def _daily_series(t: Tables):
    d = t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    return series.prepare(d, "day", "v", by=["event_type"])


DAILY_P_SQL = """p AS (SELECT event_type, day AS ts, v AS y, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS t
  FROM (SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL))"""


@query("l01_prepare_series", "WITH " + DAILY_P_SQL + " SELECT * FROM p")
def l01_prepare_series(spark, sf):
    return _daily_series(Tables(spark, sf))


@query("l02_linear_trend", "WITH " + DAILY_P_SQL + """,
f AS (SELECT event_type, count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, avg(y) AS mean FROM p GROUP BY ALL)
SELECT event_type, n, slope, intercept, slope / abs(mean) AS relative_slope,
  CASE WHEN slope / abs(mean) > 0.02 THEN 'strong_up' WHEN slope / abs(mean) > 0.005 THEN 'up'
    WHEN slope / abs(mean) < -0.02 THEN 'strong_down' WHEN slope / abs(mean) < -0.005 THEN 'down' ELSE 'stable' END AS trend FROM f""")
def l02_linear_trend(spark, sf):
    return series.linear_trend(_daily_series(Tables(spark, sf)), by=["event_type"])


@query("l03_linear_forecast", "WITH " + DAILY_P_SQL + """,
f AS (SELECT event_type, count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
  stddev_pop(y) AS sd_pop, max(t) AS tmax FROM p GROUP BY ALL),
l3 AS (SELECT p.event_type, avg(y) AS last3 FROM p JOIN f USING (event_type) WHERE t > tmax - 3 GROUP BY ALL),
h AS (SELECT f.*, l3.last3, unnest(range(1, 7)) AS step FROM f JOIN l3 USING (event_type)),
pr AS (SELECT event_type, step, greatest(0.0, 0.7 * (intercept + slope * (n - 1 + step)) + 0.3 * last3) AS forecast,
  1.96 * sd_pop * (1 + 0.1 * step) AS band FROM h)
SELECT event_type, CAST(step AS INTEGER) AS step, forecast, greatest(0.0, forecast - band) AS lower, forecast + band AS upper FROM pr""")
def l03_linear_forecast(spark, sf):
    return series.linear_forecast(_daily_series(Tables(spark, sf)), 6, by=["event_type"])


@query("l04_exp_blend_forecast")
def l04_exp_blend_forecast(spark, sf):
    return series.exp_blend_forecast(_monthly_series(Tables(spark, sf)), 6)


@query("l05_band_forecast")
def l05_band_forecast(spark, sf):
    return series.band_forecast(_monthly_series(Tables(spark, sf)), 6)


@query("l07_choose_model")
def l07_choose_model(spark, sf):
    return series.choose_model(_daily_series(Tables(spark, sf)), by=["event_type"])


@query("l08_holt_winters")
def l08_holt_winters(spark, sf):
    return series.holt_winters(_daily_series(Tables(spark, sf)), ["event_type"], horizon=7)


@query("l09_decomposition")
def l09_decomposition(spark, sf):
    return series.decompose(_daily_series(Tables(spark, sf)), 7, by=["event_type"])


@query("l10_backtest")
def l10_backtest(spark, sf):
    return series.backtest(_daily_series(Tables(spark, sf)), by=["event_type"])


@query("l11_forecast_flags")
def l11_forecast_flags(spark, sf):
    p = _daily_series(Tables(spark, sf))
    return series.forecast_flags(series.linear_forecast(p, 6, by=["event_type"]), p, by=["event_type"])


@query("l12_sufficiency", "WITH " + DAILY_P_SQL + """
SELECT event_type, count(*) AS n, least(count(*) / 30.0 * 50, 50.0)
  + 50 * (1 - least(1.0, greatest(0.0, stddev_pop(y) / abs(avg(y))))) AS score FROM p GROUP BY ALL""")
def l12_sufficiency(spark, sf):
    return series.sufficiency(_daily_series(Tables(spark, sf)), by=["event_type"])


@query("l13_sma_signal")
def l13_sma_signal(spark, sf):
    return series.sma_signal(_monthly_series(Tables(spark, sf)))


@query("l14_quadratic_forecast")
def l14_quadratic_forecast(spark, sf):
    return series.quadratic_forecast(_daily_series(Tables(spark, sf)), by=["event_type"])


@query("l15_linear_with_error", "WITH " + DAILY_P_SQL + """,
f AS (SELECT event_type, count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, regr_r2(y, t) AS r2,
  sqrt((regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t)) / (count(*) - 2)) AS std_error FROM p GROUP BY ALL)
SELECT event_type, CAST(step AS INTEGER) AS step, slope, intercept, r2, std_error, intercept + slope * (n - 1 + step) AS forecast
FROM (SELECT *, unnest(range(1, 4)) AS step FROM f)""")
def l15_linear_with_error(spark, sf):
    return series.linear_with_error(_daily_series(Tables(spark, sf)), 3, by=["event_type"])


@query("l16_drift_forecast", "WITH " + DAILY_P_SQL + """,
f AS (SELECT event_type, arg_min(y, t) AS first, arg_max(y, t) AS last, count(*) AS n FROM p GROUP BY ALL)
SELECT event_type, CAST(step AS INTEGER) AS step, last + step * (last - first) / n AS forecast
FROM (SELECT *, unnest(range(1, 4)) AS step FROM f)""")
def l16_drift_forecast(spark, sf):
    return series.drift_forecast(_daily_series(Tables(spark, sf)), 3, by=["event_type"])

"""Registered scalar-function queries.

Inputs that the tables do not hold as strings (money, unit and date text) are
*derived* from table values in the query, parsed back, and checked against
the values they came from.
"""

from __future__ import annotations



from pyspark.sql import functions as F

from kestrel.functions import scalars as S
from kestrel.operators import aggregate as agg
from kestrel.operators import cleaning
from kestrel.plans.q_aggregate import CUSTOMER_CURRENCY_SQL, FX_VALUES_SQL, customer_currency
from kestrel.plans.registry import query
from kestrel.session import Tables


@query("h01_trim_lower", """SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(trim(p_brand)) AS p_brand,
  lower(trim(p_type)) AS p_type, p_size, p_retailprice FROM part""")
def h01_trim_lower(spark, sf):
    p = Tables(spark, sf).part.withColumn("p_name", F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return cleaning.clean_table(p, lower=True)


@query("h02_missing_fill", """SELECT event_id, user_id, event_type,
  coalesce(CASE WHEN event_type <> 'error' THEN value END, 0.0) AS value FROM events""")
def h02_missing_fill(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "event_type", "value")
    ev = ev.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).withColumn(
        "empty", F.lit(None).cast("string"))
    return cleaning.handle_missing(ev, drop_empty_rows=True, drop_empty_columns=True, fill={"value": 0.0})


@query("h03_clean_numeric", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def h03_clean_numeric(spark, sf):
    o = Tables(spark, sf).orders
    raw = F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", S.clean_numeric(raw).alias("value"))


_UNITS = ["k", "M", "B", "MB", "kb", "GB", "%", "+"]
_UNIT_MULT = [1e3, 1e6, 1e9, 1.0, 1e-3, 1e3, 1.0, 1.0]


@query("h04_parse_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * (CASE l_linenumber % 8 "
       + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_UNIT_MULT)) + " END) AS value FROM lineitem")
def h04_parse_units(spark, sf):
    li = Tables(spark, sf).lineitem
    suffix = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("l_linenumber") % 8 + 1).cast("int"))
    raw = F.concat(F.col("l_quantity").cast("string"), suffix)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.parse_units(raw).alias("value"))


def _money_text(t: Tables):
    """Account balances written in four locales (US $, EU €, Indian ₹, A$)."""
    c = t.customer
    us = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    eu = F.concat(F.lit("€"), F.translate(F.format_number("c_acctbal", 2), ",.", ".,"))
    inr = F.concat(F.lit("₹"), S.indian_grouping("c_acctbal"))
    aud = F.concat(F.lit("A$"), F.format_string("%.2f", F.col("c_acctbal")))
    k = F.col("c_nationkey") % 4
    raw = F.when(k == 0, us).when(k == 1, eu).when(k == 2, inr).otherwise(aud)
    return c.select("c_custkey", "c_acctbal", "c_nationkey", raw.alias("raw"))


@query("h05_parse_money", """SELECT c_custkey, c_acctbal AS amount,
  CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'INR' ELSE 'AUD' END AS currency FROM customer""")
def h05_parse_money(spark, sf):
    m = _money_text(Tables(spark, sf))
    return m.select("c_custkey", S.parse_money("raw").alias("m")).select("c_custkey", "m.amount", "m.currency")


@query("h06_detect_currency", """SELECT CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'INR'
  ELSE 'AUD' END AS currency, count(*) AS n FROM customer GROUP BY ALL""")
def h06_detect_currency(spark, sf):
    m = _money_text(Tables(spark, sf))
    return m.groupBy(S.detect_currency("raw").alias("currency")).agg(F.count(F.lit(1)).alias("n"))


@query("h07_detect_dataset_currency", """SELECT CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR'
  WHEN 2 THEN 'INR' ELSE 'AUD' END AS currency, 'values' AS source FROM customer
GROUP BY ALL ORDER BY count(*) DESC, currency LIMIT 1""")
def h07_detect_dataset_currency(spark, sf):
    m = _money_text(Tables(spark, sf))
    return cleaning.detect_dataset_currency(m, value_col="raw", filename="accounts_2025.csv")


@query("h09_convert_currency_column", f"""WITH {CUSTOMER_CURRENCY_SQL}, fx(cur, usd_rate) AS {FX_VALUES_SQL}
SELECT c_custkey, c_acctbal * fx.usd_rate / (SELECT usd_rate FROM fx WHERE cur = 'EUR') AS c_acctbal_converted,
  'EUR' AS c_acctbal_currency FROM cc LEFT JOIN fx ON cc.currency = fx.cur""")
def h09_convert_currency_column(spark, sf):
    t = Tables(spark, sf)
    cc = customer_currency(t).select("c_custkey", "c_acctbal", "currency")
    out = cleaning.convert_column(cc, "c_acctbal", agg.fx_rates_table(spark), target="EUR", currency_col="currency")
    return out.select("c_custkey", "c_acctbal_converted", "c_acctbal_currency")


@query("h10_format_number", """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS decimal,
  '$' || format('{:,.2f}', o_totalprice) AS currency, format('{:,.0f}', round(o_totalprice)) AS integer FROM orders""")
def h10_format_number(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", S.format_number("o_totalprice", "decimal").alias("decimal"),
                    S.format_number("o_totalprice", "currency").alias("currency"),
                    S.format_number("o_totalprice", "integer").alias("integer"))


@query("h11_indian_grouping", """WITH v AS (SELECT p_partkey, p_retailprice * 1000 AS x FROM part),
s AS (SELECT p_partkey, x, printf('%.2f', x) AS fixed FROM v),
p AS (SELECT *, split_part(fixed, '.', 1) AS ip, split_part(fixed, '.', 2) AS dp FROM s)
SELECT p_partkey, CASE WHEN x < 1000 OR length(ip) <= 3 THEN fixed
  ELSE ltrim(reverse(regexp_replace(reverse(left(ip, length(ip) - 3)), '(\\d\\d)', '\\1,', 'g')), ',')
       || ',' || right(ip, 3) || '.' || dp END AS indian FROM p""")
def h11_indian_grouping(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", S.indian_grouping(F.col("p_retailprice") * 1000).alias("indian"))


_DATE_OUT = ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy",
             "MMMM dd, yyyy", "MMM dd, yyyy"]
_DATE_PY = ["%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%B %d, %Y", "%b %d, %Y"]


@query("h12_parse_mixed_dates", "SELECT o_orderkey, try_strptime(CASE o_orderkey % 9 "
       + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_DATE_PY))
       + " END, [" + ", ".join(f"'{f}'" for f in _DATE_PY) + "]) AS parsed FROM orders")
def h12_parse_mixed_dates(spark, sf):
    o = Tables(spark, sf).orders
    k = F.col("o_orderkey") % 9
    text = None
    for i, f in enumerate(_DATE_OUT):
        branch = F.date_format("o_orderdate", f)
        text = F.when(k == i, branch) if text is None else text.when(k == i, branch)
    return o.select("o_orderkey", S.parse_mixed_date(text).cast("timestamp_ntz").alias("parsed"))


@query("h13_date_parts", """SELECT o_orderkey, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month,
  day(o_orderdate) AS d_day, hour(o_orderdate) AS d_hour, isodow(o_orderdate) - 1 AS d_dayofweek,
  CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS d_is_weekend FROM orders""")
def h13_date_parts(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", *[c.alias(n) for n, c in S.date_parts("o_orderdate", "d").items()])


@query("h14_cyclic_encoding", """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM events""")
def h14_cyclic_encoding(spark, sf):
    ev = Tables(spark, sf).events
    hs, hc = S.cyclic(F.hour("ts"), 24)
    ds, dc = S.cyclic(F.weekday("ts"), 7)
    return ev.select("event_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"))


@query("h15_derived_value", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice * l_quantity AS derived_value
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def h15_derived_value(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_retailprice", "l_quantity")
    return cleaning.derive_value(j, "p_retailprice", "l_quantity").drop("p_retailprice", "l_quantity")


@query("h16_boolean_parsing", """SELECT o_orderkey, o_orderstatus = 'F' AS is_final, o_orderstatus AS status FROM orders""")
def h16_boolean_parsing(spark, sf):
    o = Tables(spark, sf).orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("no ").alias("is_final"),
        F.col("o_orderstatus").alias("status"))
    return cleaning.infer_boolean(o, ["is_final", "status"])


@query("h17_winsorize", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
SELECT o_orderkey, greatest(least(o_totalprice, hi), lo) AS o_totalprice FROM orders, q""")
def h17_winsorize(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return cleaning.winsorize(o, "o_totalprice", 0.05, 0.95)


@query("h18_log1p_if_skewed", """SELECT o_orderkey,
  CASE WHEN (SELECT abs(skewness(o_totalprice)) FROM orders) > 2 AND (SELECT min(o_totalprice) FROM orders) >= 0
    THEN ln(1 + o_totalprice) ELSE o_totalprice END AS o_totalprice,
  CASE WHEN (SELECT abs(skewness(c)) FROM (SELECT o_custkey * o_custkey * o_custkey AS c FROM orders)) > 2
    THEN ln(1 + o_custkey * o_custkey * o_custkey) ELSE o_custkey * o_custkey * o_custkey END AS cube FROM orders""")
def h18_log1p_if_skewed(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice",
                                         (F.col("o_custkey") * F.col("o_custkey") * F.col("o_custkey")).cast("double").alias("cube"))
    return cleaning.log1p_if_skewed(o, ["o_totalprice", "cube"])


@query("h19_row_statistics", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem),
m AS (SELECT *, list_avg(v) AS mu FROM a),
d AS (SELECT *, list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) AS m2,
  list_avg(list_transform(v, lambda x: pow(x - mu, 3))) AS m3, list_avg(list_transform(v, lambda x: pow(x - mu, 4))) AS m4 FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mu AS row_mean, sqrt(m2) AS row_std, list_min(v) AS row_min,
  list_max(v) AS row_max, list_max(v) - list_min(v) AS row_range, list_median(v) AS row_median,
  CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS row_skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS row_kurtosis
FROM d""")
def h19_row_statistics(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = cleaning.with_row_stats(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("h20_quiet_hours", """SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) <= 420 AS quiet
FROM events""")
def h20_quiet_hours(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", S.in_quiet_hours("ts", 22 * 60, 7 * 60).alias("quiet"))


@query("h21_severity_threshold", """SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END >= 2
  AS notify FROM events""")
def h21_severity_threshold(spark, sf):
    ev = Tables(spark, sf).events
    sev = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return ev.select("event_id", S.severity_at_least(sev, "medium").alias("notify"))


@query("h22_json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def h22_json_field(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", S.json_field("props", "$.k", "int").alias("k"))


@query("h23_fiscal_quarter", """SELECT o_orderkey, CAST(floor(((month(o_orderdate) - 4) % 12 + 12) % 12 / 3) + 1 AS INTEGER)
  AS fiscal_quarter FROM orders""")
def h23_fiscal_quarter(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", S.fiscal_quarter("o_orderdate", 3).alias("fiscal_quarter"))




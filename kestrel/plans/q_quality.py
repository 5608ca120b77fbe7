"""Registered data-quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import profile, quality
from kestrel.plans.distributed import written
from kestrel.plans.registry import query
from kestrel.session import Tables


def _docs_labels(t: Tables):
    """documents left join labels: a table with real nulls (unlabelled docs)."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


DL_SQL = "dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

RULES = [
    {"name": "qty_range", "column": "l_quantity", "type": "range", "min": 1, "max": 45},
    {"name": "discount_max", "column": "l_discount", "type": "range", "max": 0.09},
    {"name": "flag_allowed", "column": "l_returnflag", "type": "allowed", "values": ["A", "N"]},
    {"name": "status_regex", "column": "l_linestatus", "type": "regex", "pattern": "^[O]$"},
    {"name": "ship_not_null", "column": "l_shipdate", "type": "not_null"},
]


@query("i01_schema_validation", """SELECT * FROM (VALUES ('o_missing', 'missing_required_column', 'error'),
  ('o_orderstatus', 'expected_numeric', 'error')) t("column", issue, severity)""")
def i01_schema_validation(spark, sf):
    return quality.validate_schema(Tables(spark, sf).orders, ["o_orderkey", "o_missing"],
                                   {"o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderstatus": "numeric"})


_DL_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
I02_SQL = f"WITH {DL_SQL}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS n FROM dl"
    for c in _DL_COLS) + """)
SELECT "column", null_count, null_count * 100.0 / n AS null_pct,
  CASE WHEN null_count * 100.0 / n > 50 THEN 'error' WHEN null_count * 100.0 / n > 20 THEN 'warning' ELSE 'ok' END AS level
FROM c"""


@query("i02_completeness", I02_SQL)
def i02_completeness(spark, sf):
    return quality.completeness(_docs_labels(Tables(spark, sf)))


@query("i03_id_uniqueness", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count(DISTINCT {c}) - (CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0
  THEN 1 ELSE 0 END) AS duplicates, (count(*) - count(DISTINCT {c}) - (CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0
  THEN 1 ELSE 0 END)) * 100.0 / count(*) AS duplicate_pct FROM lineitem""" for c in ["l_orderkey", "l_partkey", "l_suppkey"]))
def i03_id_uniqueness(spark, sf):
    return quality.id_uniqueness(Tables(spark, sf).lineitem)


def _rule_sql(r):
    c = r["column"]
    if r["type"] == "not_null":
        return f"{c} IS NULL"
    if r["type"] == "range":
        parts = []
        if r.get("min") is not None:
            parts.append(f"{c} < {r['min']}")
        if r.get("max") is not None:
            parts.append(f"{c} > {r['max']}")
        return f"{c} IS NOT NULL AND ({' OR '.join(parts)})"
    if r["type"] == "allowed":
        return f"{c} IS NOT NULL AND {c} NOT IN (" + ", ".join(f"'{v}'" for v in r["values"]) + ")"
    return f"{c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), '{r['pattern']}')"


I04_SQL = " UNION ALL ".join(
    f"""SELECT '{r['name']}' AS rule, '{r['column']}' AS "column", (SELECT count(*) FROM lineitem WHERE {_rule_sql(r)}) AS violations,
  coalesce((SELECT list_sort(list(v)) FROM (SELECT DISTINCT coalesce(CAST({r['column']} AS VARCHAR), 'null') AS v,
    CAST({r['column']} AS VARCHAR) AS o FROM lineitem WHERE {_rule_sql(r)} ORDER BY o NULLS FIRST LIMIT 10)), []) AS samples"""
    for r in RULES)


@query("i04_rule_checks", I04_SQL)
def i04_rule_checks(spark, sf):
    return quality.rule_checks(Tables(spark, sf).lineitem, RULES)


@query("i05_quality_score", f"""WITH {DL_SQL},
comp AS (SELECT "column", null_count, null_pct, level FROM ({I02_SQL.replace("WITH " + DL_SQL + ", ", "WITH ")})),
n AS (SELECT count(*) AS n FROM dl),
dup AS (SELECT count(*) - count(DISTINCT doc_id) AS dups FROM dl),
a AS (SELECT sum(null_count) AS nulls, count(*) FILTER (WHERE level = 'error') AS e1,
  count(*) FILTER (WHERE level = 'warning') AS w1, count(*) FILTER (WHERE level = 'ok') AS p1 FROM comp)
SELECT (1 - nulls / (n * 6)) * 30 AS completeness, (1 - dups / (n * 1)) * 20 AS uniqueness,
  CAST(greatest(0.0, 30 - e1 * 5 - (w1 + CASE WHEN dups > 0 THEN 1 ELSE 0 END) * 2) AS DOUBLE) AS consistency,
  (p1 + CASE WHEN dups = 0 THEN 1 ELSE 0 END) / 7.0 * 20 AS validity,
  (1 - nulls / (n * 6)) * 30 + (1 - dups / (n * 1)) * 20
   + greatest(0.0, 30 - e1 * 5 - (w1 + CASE WHEN dups > 0 THEN 1 ELSE 0 END) * 2)
   + (p1 + CASE WHEN dups = 0 THEN 1 ELSE 0 END) / 7.0 * 20 AS score
FROM a, n, dup""")
def i05_quality_score(spark, sf):
    return quality.quality_score(_docs_labels(Tables(spark, sf)))


@query("i06_quality_score_weighted", """WITH n AS (SELECT count(*) AS n,
  sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT) AS nulls FROM orders),
d AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders))
SELECT 1 - nulls / (n * 2) AS completeness, distinct_rows / n AS uniqueness, 1.0 AS consistency,
  (1 - nulls / (n * 2)) * 0.4 + distinct_rows / n * 0.3 + 0.3 AS score FROM n, d""")
def i06_quality_score_weighted(spark, sf):
    return quality.quality_score_weighted(Tables(spark, sf).orders.select("o_custkey", "o_orderstatus"))


@query("i07_issue_report")
def i07_issue_report(spark, sf):
    return quality.issue_report(_docs_labels(Tables(spark, sf)), target="quality")


@query("i07b_issue_score")
def i07b_issue_score(spark, sf):
    return quality.issue_score(quality.issue_report(_docs_labels(Tables(spark, sf)), target="quality"))


@query("i08_detect_issues")
def i08_detect_issues(spark, sf):
    return quality.detect_issues(_docs_labels(Tables(spark, sf)))


@query("i09_impute", f"""WITH {DL_SQL}
SELECT doc_id, lang, source, n_chars, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM dl))::INTEGER AS quality,
  coalesce(toxic, 0) AS toxic FROM dl""")
def i09_impute(spark, sf):
    return quality.impute(_docs_labels(Tables(spark, sf)), {"quality": "median", "toxic": "constant"},
                          constants={"toxic": 0})


@query("i10_auto_impute")
def i10_auto_impute(spark, sf):
    return quality.auto_impute(_docs_labels(Tables(spark, sf)))


@query("i11_inf_and_constant")
def i11_inf_and_constant(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    o = o.withColumn("ratio", F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 1000))
    return quality.replace_inf_drop_constant(o.withColumn("const", F.lit(1)))


@query("i12_type_repair")
def i12_type_repair(spark, sf):
    o = Tables(spark, sf).orders.select(F.col("o_orderkey").cast("string").alias("key_text"),
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                                         F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("final"))
    return quality.type_repair(o)


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
I13_SQL = " UNION ALL ".join(f"""SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
  FROM lineitem WHERE {c} IS NOT NULL), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT '{c}' AS "column", q1, q3, lower, upper, count(*) AS n,
  count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outliers,
  count(*) FILTER (WHERE {c} < lower OR {c} > upper) * 100.0 / count(*) AS outlier_pct
FROM lineitem, b WHERE {c} IS NOT NULL GROUP BY q1, q3, lower, upper)""" for c in _NUM)


@query("i13_iqr_outliers", I13_SQL)
def i13_iqr_outliers(spark, sf):
    return quality.iqr_outliers(Tables(spark, sf).lineitem, _NUM).drop("samples")


@query("i14_zscore_outliers", " UNION ALL ".join(f"""SELECT * FROM (WITH s AS (SELECT avg({c}) AS mean,
  stddev_samp({c}) AS std, count({c}) AS n FROM lineitem)
SELECT '{c}' AS "column", mean, std, n, count(*) FILTER (WHERE abs({c} - mean) / std > 3) AS outliers,
  count(*) FILTER (WHERE abs({c} - mean) / std > 3) * 100.0 / n AS outlier_pct
FROM lineitem, s WHERE {c} IS NOT NULL GROUP BY mean, std, n)""" for c in _NUM))
def i14_zscore_outliers(spark, sf):
    return quality.zscore_outliers(Tables(spark, sf).lineitem, _NUM)


@query("i15_mad_outliers", """WITH b AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
m AS (SELECT quantile_cont(x, 0.5) AS median, avg(x) AS mu, stddev_pop(x) AS sd FROM b),
d AS (SELECT quantile_cont(abs(x - median), 0.5) AS mad FROM b, m),
f AS (SELECT count(*) AS n, count(*) FILTER (WHERE CASE WHEN mad <> 0 THEN abs(0.6745 * (x - median) / mad) > 3.5
  ELSE abs((x - mu) / sd) > 3 END) AS outliers FROM b, m, d)
SELECT n, outliers, outliers * 100.0 / n AS outlier_pct, median, mad,
  CASE WHEN outliers * 100.0 / n > 10 THEN 'high' WHEN outliers * 100.0 / n > 5 THEN 'medium' ELSE 'low' END AS severity
FROM f, m, d""")
def i15_mad_outliers(spark, sf):
    return quality.mad_outliers(Tables(spark, sf).orders, "o_totalprice")


@query("i16_cap_outliers", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders),
s AS (SELECT avg(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 1.0 ELSE 0.0 END) * 100 AS share FROM orders, q)
SELECT o_orderkey, CASE WHEN share > 0 AND share < 10 THEN greatest(least(o_totalprice, hi), lo) ELSE o_totalprice END
  AS o_totalprice FROM orders, q, s""")
def i16_cap_outliers(spark, sf):
    return quality.cap_outliers(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("i17_auto_fix")
def i17_auto_fix(spark, sf):
    return quality.auto_fix(_docs_labels(Tables(spark, sf)))[0]


# ------------------------------------------------------------------ J

_J1_COLS = [("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False)]
_J1_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
J01_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{_J1_TYPES[c]}' AS dtype, (SELECT count(*) FROM customer) AS rows,
  count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct,
  {f'CAST(min({c}) AS DOUBLE)' if num else 'NULL::DOUBLE'} AS min, {f'CAST(max({c}) AS DOUBLE)' if num else 'NULL::DOUBLE'} AS max,
  {f'avg({c})' if num else 'NULL::DOUBLE'} AS mean,
  (SELECT list_sort(list(v)) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer WHERE {c} IS NOT NULL
     ORDER BY v LIMIT 3)) AS samples FROM customer""" for c, num in _J1_COLS)


@query("j01_infer_schema", J01_SQL)
def j01_infer_schema(spark, sf):
    return profile.infer_schema(Tables(spark, sf).customer)


@query("j02_column_roles")
def j02_column_roles(spark, sf):
    from kestrel.plans.common import sales
    return profile.column_roles(sales(Tables(spark, sf)))


@query("j02b_best_columns")
def j02b_best_columns(spark, sf):
    from kestrel.plans.common import sales
    s = written(sales(Tables(spark, sf)), "sales")
    return profile.best_columns(profile.column_roles(s), s)


@query("j05_metric_dimension_ranking")
def j05_metric_dimension_ranking(spark, sf):
    from kestrel.plans.common import sales
    return profile.metric_dimension_ranking(sales(Tables(spark, sf)))


@query("j06_deep_profile")
def j06_deep_profile(spark, sf):
    from kestrel.plans.common import SALES_ORDER, sales
    return profile.deep_profile(sales(Tables(spark, sf)), "amount", SALES_ORDER, category="segment")


@query("j07_cooccurrence", """WITH l AS (
  SELECT 'o_orderstatus' AS col_a, 'o_orderpriority' AS col_b, o_orderstatus AS value_a, o_orderpriority AS value_b FROM orders
  UNION ALL SELECT 'o_orderstatus', 'c_mktsegment', o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'o_orderpriority', 'c_mktsegment', o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT col_a, col_b, value_a, value_b, count(*) AS count FROM l WHERE value_a IS NOT NULL AND value_b IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY col_a, col_b ORDER BY count DESC, value_a, value_b) AS rank FROM c QUALIFY rank <= 10""")
def j07_cooccurrence(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return profile.cooccurrence(j, ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


@query("j08_target_task", """SELECT 'quality' AS target, 'numeric' AS kind, count(DISTINCT quality) AS distinct,
  count(quality) AS non_null, CASE WHEN count(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END AS task
FROM labels""")
def j08_target_task(spark, sf):
    return profile.detect_target_and_task(Tables(spark, sf).labels, "quality")


@query("j09_feature_metadata", """SELECT 'p_size' AS feature, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max,
  avg(p_size) AS mean, NULL::VARCHAR[] AS options FROM part
UNION ALL SELECT 'p_brand', NULL, NULL, NULL, (SELECT list_sort(list(p_brand)) FROM (SELECT p_brand FROM part
  WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10))""")
def j09_feature_metadata(spark, sf):
    return profile.feature_metadata(Tables(spark, sf).part, ["p_size", "p_brand"])

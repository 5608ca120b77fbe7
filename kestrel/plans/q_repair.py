"""Repair of a table with gaps, mixed texts and repeated rows, all made from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.operators import quality
from kestrel.plans.registry import query
from kestrel.session import Tables


def gappy(t: Tables):
    """Orders with gaps in price, date and status, a note that nine of ten rows lack, and a
    text column of three kinds."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k, F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("o_orderdate")).alias("order_date"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 10 == 0, F.lit("seen")).alias("note"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, F.concat(F.lit("9"), F.col("o_custkey").cast("string"))).otherwise(
            F.col("o_orderpriority")).alias("mixed"))


GAPPY_SQL = """g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS order_date, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN 'seen' END AS note,
  CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '9' || CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS mixed FROM orders)"""
FILLED_SQL = """f AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)) AS price,
  coalesce(last_value(order_date IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(order_date IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS order_date,
  coalesce(status, (SELECT status FROM g WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
  note, mixed FROM g)"""

_COLUMNS = ("o_orderkey", "price", "order_date", "status", "note", "mixed")
_BOOLEANS = ", ".join(f"'{w}'" for w in [*scalars.TRUE_VALUES, *scalars.FALSE_VALUES])


def _kind_sql(c: str) -> str:
    if c not in ("status", "note", "mixed"):
        return f"CASE WHEN {c} IS NULL THEN 'missing' ELSE 'value' END"
    return (f"CASE WHEN {c} IS NULL THEN 'missing' WHEN lower(trim({c})) IN ({_BOOLEANS}) THEN 'boolean' "
            f"WHEN try_cast({c} AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'value' END")


KINDS_SQL = "k AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {_kind_sql(c)}) AS kinds FROM g""" for c in _COLUMNS) + ")"


@query("i06b_type_consistency", f"WITH {GAPPY_SQL}, {KINDS_SQL} SELECT *, kinds <= 2 AS consistent FROM k")
def i06b_type_consistency(spark, sf):
    return quality.type_consistency(gappy(Tables(spark, sf)))


@query("i06c_quality_score_mixed", f"""WITH {GAPPY_SQL}, {KINDS_SQL},
s AS (SELECT 1 - (SELECT {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in _COLUMNS)} FROM g) / ((SELECT count(*) FROM g) * 6.0) AS completeness,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) / (SELECT count(*) FROM g) AS uniqueness,
  (SELECT avg((kinds <= 2)::INT) FROM k) AS consistency)
SELECT *, completeness * 0.4 + uniqueness * 0.3 + consistency * 0.3 AS score FROM s""")
def i06c_quality_score_mixed(spark, sf):
    return quality.quality_score_weighted(gappy(Tables(spark, sf)))


@query("i10b_impute_plan", f"""WITH {GAPPY_SQL}, c AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n, '{how}' AS how FROM g"""
    for c, how in (("price", "median"), ("order_date", "ffill+bfill"), ("status", "mode"), ("note", "mode"))) + """)
SELECT "column", missing, missing * 100.0 / n AS missing_pct, CASE WHEN missing > 0.8 * n THEN 'drop' ELSE how END AS strategy FROM c""")
def i10b_impute_plan(spark, sf):
    return quality.impute_plan(gappy(Tables(spark, sf)), aggressive=True)


@query("i10c_impute_in_order", f"WITH {GAPPY_SQL}, {FILLED_SQL} SELECT * EXCLUDE (note) FROM f")
def i10c_impute_in_order(spark, sf):
    return quality.auto_impute(gappy(Tables(spark, sf)), order=["o_orderkey"], aggressive=True)


@query("i12b_unit_repair", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey * 1000.0 END AS visits,
  CAST(o_custkey AS DOUBLE) AS paid, o_orderpriority FROM orders""")
def i12b_unit_repair(spark, sf):
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    o = Tables(spark, sf).orders.select(
        k, F.when(k % 4 == 0, "n/a").otherwise(F.concat(cust, F.lit("k"))).alias("visits"),
        F.concat(F.lit("$"), cust).alias("paid"), "o_orderpriority")
    return quality.type_repair(o)


def _repeated(t: Tables):
    g = gappy(t)
    return g.unionByName(g.where(F.col("o_orderkey") % 9 == 0))


@query("i17b_auto_fixed", f"""WITH {GAPPY_SQL}, {FILLED_SQL},
b AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM f)
SELECT o_orderkey, greatest(least(price, hi), lo) AS price, order_date, status, note, mixed, CAST(year(order_date) AS INTEGER) AS order_year,
  CAST(month(order_date) AS INTEGER) AS order_month, CAST(isodow(order_date) - 1 AS INTEGER) AS order_day_of_week,
  isodow(order_date) >= 6 AS order_is_weekend FROM f, b""")
def i17b_auto_fixed(spark, sf):
    return quality.auto_fix(_repeated(Tables(spark, sf)), order=["o_orderkey"])[0]


@query("i17c_fix_log", f"""WITH {GAPPY_SQL}
SELECT 'dedupe' AS step, '*' AS "column", count(*) FILTER (WHERE o_orderkey % 9 = 0) AS "rows", 'repeated rows removed' AS detail FROM g
UNION ALL SELECT 'missing', 'price', count(*) FILTER (WHERE price IS NULL), 'median' FROM g
UNION ALL SELECT 'missing', 'order_date', count(*) FILTER (WHERE order_date IS NULL), 'ffill+bfill' FROM g
UNION ALL SELECT 'missing', 'status', count(*) FILTER (WHERE status IS NULL), 'mode' FROM g
UNION ALL SELECT 'missing', 'note', count(*) FILTER (WHERE note IS NULL), 'skip' FROM g
UNION ALL SELECT 'enrich', c, (SELECT count(*) FROM g), 'derived'
  FROM (SELECT unnest(['order_year', 'order_month', 'order_day_of_week', 'order_is_weekend']) AS c)""")
def i17c_fix_log(spark, sf):
    log = quality.auto_fix(_repeated(Tables(spark, sf)), order=["o_orderkey"])[1]
    return log.where(F.col("step") != "score")  # its detail holds two scores as text

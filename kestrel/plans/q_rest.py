"""Queries of file forms, ordered previews, unions, merged edges, forecasts and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import frame, ml, series
from kestrel.operators import graph as G
from kestrel.operators import windows as win
from kestrel.plans.common import SALES_SQL, sales
from kestrel.plans.q_kpi import DAILY_P_SQL, _daily_series, _monthly_series
from kestrel.plans.registry import query
from kestrel.session import Tables, scratch_path
from kestrel.sources import files

BLOCK = 1000  # customers a file


def _blocks(t: Tables):
    """Customers in blocks of consecutive keys, so at most BLOCK rows each."""
    return t.customer.withColumn("_block", F.floor(F.col("c_custkey") / BLOCK))


@query("a03b_json_documents", "SELECT * FROM customer")
def a03b_json_documents(spark, sf):
    """Each file is one JSON document, an array of customers over several lines."""
    t = Tables(spark, sf)
    path = scratch_path(spark, "json-documents")
    rows = F.transform(F.collect_list(F.struct(*t.customer.columns)), lambda r: F.to_json(r))
    docs = _blocks(t).groupBy("_block").agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(spark, path, schema=t.customer.schema)


@query("a04_text_files", "SELECT c_name AS line FROM customer")
def a04_text_files(spark, sf):
    """Files of several lines, each read as one text, and their lines."""
    path = scratch_path(spark, "text")
    texts = _blocks(Tables(spark, sf)).groupBy("_block").agg(F.array_join(F.collect_list("c_name"), "\n").alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_text(spark, path).select(F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))


@query("a06b_files_with_lineage", "SELECT o_orderkey, o_orderstatus, o_totalprice, true AS from_its_file FROM orders")
def a06b_files_with_lineage(spark, sf):
    """A folder of files per status, unioned with the name of the file
    each row comes from."""
    o = Tables(spark, sf).orders
    paths = []
    for status in ("F", "O", "P"):
        paths.append(scratch_path(spark, f"lineage-{status}"))
        o.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(paths[-1])
    u = files.read_files_with_lineage(spark, paths, "parquet")
    return u.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("_source_file").rlike(r"^part-.*\.parquet$").alias("from_its_file"))


@query("f04b_ordered_preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def f04b_ordered_preview(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return frame.preview(o, 100, 4, order=["o_totalprice"])


@query("g01b_union_missing_columns", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders""")
def g01b_union_missing_columns(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    open_ = F.col("o_orderstatus") == "P"
    return frame.union_all([o.where(~open_), o.where(open_).drop("o_totalprice")])


@query("m04b_merged_edges", f"""WITH {SALES_SQL}, r AS (SELECT CAST(invoice AS VARCHAR) AS inv, customer AS cust, CAST(product AS VARCHAR) AS prod,
  strftime(date, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS g FROM sales JOIN orders ON o_orderkey = invoice),
e AS (SELECT g, 'invoice:' || inv AS src, 'customer:' || cust AS dst, 'sold_to' AS relation FROM r
  UNION ALL SELECT g, 'invoice:' || inv, 'product:' || prod, 'contains' FROM r
  UNION ALL SELECT g, 'invoice:' || inv, 'date:' || day, 'occurred_on' FROM r
  UNION ALL SELECT g, 'customer:' || cust, 'product:' || prod, 'purchased' FROM r),
w AS (SELECT g, src, dst, relation, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY ALL)
SELECT src, dst, relation, arg_max(weight, g) AS weight FROM w GROUP BY ALL""")
def m04b_merged_edges(spark, sf):
    t = Tables(spark, sf)
    s = sales(t).join(t.orders.select(F.col("o_orderkey").alias("invoice"), "o_orderstatus"), "invoice")
    parts = [G.star_graph(s.where(c), "invoice", "customer", "product", "date", amount="amount")
             for c in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F")]
    return G.merge_graphs(parts)[1]


@query("l04b_blend_per_series", f"""WITH RECURSIVE {DAILY_P_SQL}, f AS (SELECT event_type, count(*) AS n, regr_slope(y, t) AS slope,
  regr_intercept(y, t) AS intercept, arg_max(y, t) AS last FROM p GROUP BY ALL),
s AS (SELECT event_type, 0 AS step, last AS forecast FROM f UNION ALL SELECT s.event_type, step + 1,
  greatest(0, 0.3 * (intercept + slope * (n + step)) + 0.7 * forecast) FROM s JOIN f USING (event_type) WHERE step < 6)
SELECT event_type, CAST(step AS INTEGER) AS step, forecast FROM s WHERE step > 0""")
def l04b_blend_per_series(spark, sf):
    return series.exp_blend_forecast(_daily_series(Tables(spark, sf)), 6, by=["event_type"])


@query("l05b_band_per_series", f"""WITH {DAILY_P_SQL}, f AS (SELECT event_type, count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
  stddev_samp(y) AS sd, regr_r2(y, t) AS r2 FROM p GROUP BY ALL), h AS (SELECT *, unnest(range(1, 7)) AS step FROM f)
SELECT event_type, CAST(step AS INTEGER) AS step, intercept + slope * (n - 1 + step) AS forecast,
  intercept + slope * (n - 1 + step) - 1.96 * 0.3 * step * sd AS lower, intercept + slope * (n - 1 + step) + 1.96 * 0.3 * step * sd AS upper, r2 FROM h""")
def l05b_band_per_series(spark, sf):
    return series.band_forecast(_daily_series(Tables(spark, sf)), 6, by=["event_type"])


@query("l07b_choose_seasonal_model", f"""WITH {DAILY_P_SQL}, l AS (SELECT event_type, y, lag(y, 7) OVER w AS y7, lag(y, 12) OVER w AS y12 FROM p
  WINDOW w AS (PARTITION BY event_type ORDER BY t)),
s AS (SELECT event_type, count(*) AS n, coalesce(corr(y, y7) > 0.3, false) OR coalesce(corr(y, y12) > 0.3, false) AS seasonal FROM l GROUP BY ALL)
SELECT *, CASE WHEN n >= 24 AND seasonal THEN 'holt_winters' WHEN n >= 10 THEN 'linear' WHEN n >= 3 THEN 'drift' ELSE 'naive' END AS method FROM s""")
def l07b_choose_seasonal_model(spark, sf):
    p = _daily_series(Tables(spark, sf))
    seasonal = win.autocorrelation(p, "y", ["t"], lags=(7, 12), by=["event_type"]).groupBy("event_type").agg(
        F.coalesce(F.bool_or("seasonal"), F.lit(False)).alias("seasonal"))
    return series.choose_model(p, by=["event_type"], seasonal=seasonal)


@query("p03b_quantile_bins", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders)
SELECT o_orderkey, o_totalprice, CAST(len(list_filter(e, lambda x: x <= o_totalprice)) AS INTEGER) AS bin FROM orders, e""")
def p03b_quantile_bins(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return ml.bin_column(o, "o_totalprice", ml.bin_edges(o, "o_totalprice", 5))


@query("p03c_uniform_bins", """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders)
SELECT o_orderkey, o_totalprice, CAST(len(list_filter([1, 2, 3, 4], lambda i: lo + i * w <= o_totalprice)) AS INTEGER) AS bin FROM orders, e""")
def p03c_uniform_bins(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return ml.bin_column(o, "o_totalprice", ml.bin_edges(o, "o_totalprice", 5, "uniform"))


@query("p03d_kmeans_bins")
def p03d_kmeans_bins(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return ml.bin_column(o, "o_totalprice", ml.bin_edges(o, "o_totalprice", 5, "kmeans"))


@query("l04c_blend_monthly", """WITH RECURSIVE m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
p AS (SELECT y, row_number() OVER (ORDER BY month) - 1 AS t FROM m),
f AS (SELECT count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, arg_max(y, t) AS last FROM p),
s AS (SELECT 0 AS step, last AS forecast FROM f UNION ALL SELECT step + 1,
  greatest(0, 0.3 * (intercept + slope * (n + step)) + 0.7 * forecast) FROM s, f WHERE step < 6)
SELECT CAST(step AS INTEGER) AS step, forecast FROM s WHERE step > 0""")
def l04c_blend_monthly(spark, sf):
    return series.exp_blend_forecast(_monthly_series(Tables(spark, sf)), 6)

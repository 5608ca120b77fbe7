"""Queries that give findings where the sales tables have none: relations between measures of
texts, rows without a partner, and tables and links of pages made from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import aggregate, kpi
from kestrel.operators import text as X
from kestrel.plans.registry import query
from kestrel.session import Tables


def measured(t: Tables):
    """Documents with their size in code points, words and lines."""
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", "lang", "source", F.length(text).alias("size"),
                              F.size(F.split(text, " ")).alias("words"), F.size(F.split(text, "\n")).alias("lines"))


MEASURED_SQL = """d AS (SELECT doc_id, lang, source, length(coalesce(text, '')) AS size,
  len(string_split(coalesce(text, ''), ' ')) AS words, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents)"""


@query("c07b_documents_without_label", "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def c07b_documents_without_label(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left_anti")


_PAIRS = (("size", "words"), ("size", "lines"), ("words", "lines"))


@query("d21b_text_correlations", f"WITH {MEASURED_SQL}, r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM d" for a, b in _PAIRS) + """)
SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE abs(r) >= 0.3""")
def d21b_text_correlations(spark, sf):
    return aggregate.correlation_pairs(measured(Tables(spark, sf)), ["size", "words", "lines"], 0.3)


@query("k02b_size_drivers", f"WITH {MEASURED_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'driver' AS kind, '{c}' AS factor, corr({c}, size) AS impact, least(abs(corr({c}, size)), 0.9) AS confidence FROM d"
    for c in ("words", "lines", "doc_id")) + ") WHERE abs(impact) > 0.3")
def k02b_size_drivers(spark, sf):
    return kpi.root_cause_drivers(measured(Tables(spark, sf)), "size", ["words", "lines", "doc_id"])


@query("k04b_size_segments", f"""WITH {MEASURED_SQL},
l AS (SELECT 'lang' AS col, lang AS category, size AS x FROM d UNION ALL SELECT 'source', source, size FROM d),
g AS (SELECT col, category, avg(x) AS mean, count(*) AS n FROM l WHERE category IS NOT NULL GROUP BY ALL),
i AS (SELECT 'segment' AS kind, col || '=' || category AS factor, mean / (SELECT avg(size) FROM d) - 1 AS impact,
  least(0.8, n / 50.0) AS confidence FROM g WHERE n >= 5)
SELECT * FROM i WHERE abs(impact) > 0.2""")
def k04b_size_segments(spark, sf):
    return kpi.root_cause_segments(measured(Tables(spark, sf)), "size", ["lang", "source"], top=None)


@query("k07b_size_anomalies", f"""WITH {MEASURED_SQL},
q AS (SELECT quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3, avg(size) AS mu, stddev_samp(size) AS sd FROM d)
SELECT doc_id, size AS value, abs(size - mu) / sd AS z, CASE WHEN size > mu THEN 'high' ELSE 'low' END AS direction FROM d, q
WHERE size < q1 - 1.5 * (q3 - q1) OR size > q3 + 1.5 * (q3 - q1) ORDER BY z DESC, doc_id LIMIT 5""")
def k07b_size_anomalies(spark, sf):
    return kpi.trend_anomalies(measured(Tables(spark, sf)), "size", "doc_id")


# ------------------------------------------------------------------ pages and texts made from the orders

_LINES = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS i,
  CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part, CAST(l_quantity AS VARCHAR) AS quantity, l_suppkey FROM lineitem)"""


def _order_lines(t: Tables, row):
    """(l_orderkey, rows): the formatted lines of each order, of which there are few."""
    key = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    lines = F.array_sort(F.collect_list(key))
    return t.lineitem.groupBy("l_orderkey").agg(lines.alias("ls")).select("l_orderkey", F.transform("ls", row).alias("rows"))


@query("n10b_order_markdown_tables", f"""WITH {_LINES}
SELECT l_orderkey, 0 AS table_index, i - 1 AS row_index, unnest(['line', 'part', 'quantity']) AS "column",
  unnest([line, part, quantity]) AS value FROM l""")
def n10b_order_markdown_tables(spark, sf):
    def row(s):
        return F.concat(F.lit("| "), F.concat_ws(" | ", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"),
                                                 s["l_quantity"].cast("string")), F.lit(" |"))
    texts = _order_lines(Tables(spark, sf), row).select("l_orderkey", F.concat_ws(
        "\n", F.lit("Lines of the order:"), F.lit("| line | part | quantity |"), F.lit("| --- | --- | --- |"), "rows",
        F.lit("End.")).alias("text"))
    return X.markdown_tables(texts, "text", "l_orderkey")


def _order_pages(t: Tables):
    def row(s):
        return F.concat(F.lit("<tr><td>"), s["l_linenumber"].cast("string"), F.lit("</td><td><a href=\"https://shop"),
                        (s["l_suppkey"] % 7).cast("string"), F.lit(".example/part/"), s["l_partkey"].cast("string"), F.lit("\">"),
                        s["l_partkey"].cast("string"), F.lit("</a></td><td>"), s["l_quantity"].cast("string"), F.lit("</td></tr>"))
    return _order_lines(t, row).select(
        F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://orders.example/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("<html><head><title>Order</title></head><body><p>Lines</p><table><tr><th>line</th><th>part</th><th>quantity</th></tr>"),
                 F.concat_ws("", "rows"), F.lit("</table></body></html>")).alias("html"))


# a page's links are a set: a part that an order names twice from one shop is one link
@query("n09d_order_page_links", """SELECT 'shop' || (l_suppkey % 7) || '.example' AS domain, count(DISTINCT (l_orderkey, l_partkey)) AS links,
  count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY 1""")
def n09d_order_page_links(spark, sf):
    return X.domain_link_counts(X.page_links(X.extract_pages(_order_pages(Tables(spark, sf)))))


@query("n09e_order_page_cells", f"""WITH {_LINES}, c AS (SELECT l_orderkey, i, [line, part, quantity] AS v FROM l
  UNION ALL SELECT DISTINCT l_orderkey, 0, ['line', 'part', 'quantity'] FROM l)
SELECT l_orderkey AS page_id, 0 AS table_index, i AS row_index, unnest([0, 1, 2]) AS column_index, unnest(v) AS value FROM c""")
def n09e_order_page_cells(spark, sf):
    return X.page_table_cells(X.extract_pages(_order_pages(Tables(spark, sf))))

"""Queries of balance, bands, violins, bullets, degrees, error slices, spans, grounding, topics
and term weights: parts of rows whose first query shows another part."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import aggregate, charts, ml
from kestrel.operators import graph as G
from kestrel.operators import text as X
from kestrel.plans.common import SALES_ORDER, SALES_ORDER_SQL, SALES_SQL, sales
from kestrel.plans.q_graph import STAR_EDGES_SQL, _star
from kestrel.plans.q_ml import PRED_SQL, _predictions
from kestrel.plans.registry import query
from kestrel.session import Tables


@query("d24b_category_extremes", """WITH c AS (SELECT p_brand AS category, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY ALL),
s AS (SELECT sum(n) AS total, count(*) AS k, avg(n) AS mean, stddev_samp(n) AS sd FROM c),
r AS (SELECT category, n, n * 100.0 / total AS pct, k, mean, sd,
  row_number() OVER (ORDER BY n DESC, category) AS t, row_number() OVER (ORDER BY n, category DESC) AS b FROM c, s)
SELECT 'top' AS kind, category, n, pct FROM r WHERE t <= 2 AND k >= 4 UNION ALL SELECT 'bottom', category, n, pct FROM r WHERE b <= 2 AND k >= 4
UNION ALL SELECT 'high', category, n, pct FROM r WHERE n > mean + 2 * sd
UNION ALL SELECT 'low', category, n, pct FROM r WHERE mean > 2 * sd AND n < mean - 2 * sd""")
def d24b_category_extremes(spark, sf):
    return aggregate.category_extremes(Tables(spark, sf).part, "p_brand")


@query("q13_confidence_band", """WITH r AS (SELECT coalesce(o_totalprice, 0) AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
  count(*) OVER () AS n FROM orders),
p AS (SELECT v, CAST((rn - 1) // greatest(1, n // least(30, n)) + 1 AS INTEGER) AS point, least(30, n) AS used FROM r)
SELECT point, avg(v) AS mean, avg(v) - stddev_pop(v) AS lower, avg(v) + stddev_pop(v) AS upper FROM p WHERE point <= used GROUP BY point""")
def q13_confidence_band(spark, sf):
    return charts.confidence_band(Tables(spark, sf).orders, "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("q14b_violin", """WITH r AS (SELECT p_brand AS category, p_retailprice AS x FROM part WHERE p_brand IN (
  SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5) AND p_retailprice IS NOT NULL),
s AS (SELECT category, count(*) AS n, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3, max(x) AS max, avg(x) AS mean FROM r GROUP BY category),
b AS (SELECT category, CASE WHEN s.max > s.min THEN least(19, floor((x - s.min) / ((s.max - s.min) / 20))) ELSE 0 END::INT AS bin, count(*) AS c
  FROM r JOIN s USING (category) GROUP BY ALL)
SELECT s.*, (SELECT string_agg(bin || ':' || c, ',' ORDER BY bin) FROM b WHERE b.category = s.category) AS shape FROM s""")
def q14b_violin(spark, sf):
    v = charts.violin(Tables(spark, sf).part, "p_brand", "p_retailprice")
    return v.withColumn("shape", F.array_join(F.transform("shape", lambda s: F.concat_ws(":", s["bin"], s["count"])), ","))


@query("q14c_bullet", f"""WITH {SALES_SQL}, l AS (SELECT amount AS value, quantity AS target FROM sales ORDER BY
  {', '.join(c.strip() + ' DESC' for c in SALES_ORDER_SQL.split(','))} LIMIT 1)
SELECT value, target, target * 0.7 AS low_end, target * 1.2 AS axis_end FROM l""")
def q14c_bullet(spark, sf):
    return charts.bullet(sales(Tables(spark, sf)), "amount", "quantity", SALES_ORDER)


@query("m05c_degrees", f"""WITH {STAR_EDGES_SQL}, o AS (SELECT src AS id, count(*) AS c FROM edges GROUP BY ALL),
i AS (SELECT dst AS id, count(*) AS c FROM edges GROUP BY ALL)
SELECT n.id, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) + coalesce(i.c, 0) AS degree
FROM nodes n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id""")
def m05c_degrees(spark, sf):
    return G.degrees(*_star(Tables(spark, sf)))


@query("m06b_revenue_table", f"""WITH {STAR_EDGES_SQL}, nb AS (SELECT e.src AS invoice, max(n.label) FILTER (WHERE n.type = 'customer') AS customer,
  max(n.label) FILTER (WHERE n.type = 'product') AS product, max(n.label) FILTER (WHERE n.type = 'date') AS date
  FROM edges e JOIN nodes n ON n.id = e.dst GROUP BY e.src)
SELECT i.id AS invoice, coalesce(customer, 'Unknown Customer') AS customer, coalesce(product, 'General Item') AS product,
  coalesce(date, 'Unknown Date') AS date, coalesce(i.amount, 0) AS amount FROM nodes i LEFT JOIN nb ON nb.invoice = i.id
WHERE i.type = 'invoice' AND (i.amount > 0 OR customer IS NOT NULL OR product IS NOT NULL)""")
def m06b_revenue_table(spark, sf):
    return G.revenue_table(*_star(Tables(spark, sf)))


@query("p28c_areas", f"""WITH {PRED_SQL}, g AS (SELECT score, sum(label) AS a, sum(1 - label) AS b FROM p GROUP BY score),
c AS (SELECT score, sum(a) OVER w / sum(a) OVER () AS tpr, sum(b) OVER w / sum(b) OVER () AS fpr, sum(a) OVER w / (sum(a) OVER w + sum(b) OVER w) AS precision
  FROM g WINDOW w AS (ORDER BY score DESC)),
d AS (SELECT *, lag(tpr, 1, 0) OVER (ORDER BY score DESC) AS t0, lag(fpr, 1, 0) OVER (ORDER BY score DESC) AS f0 FROM c)
SELECT sum((fpr - f0) * (tpr + t0) / 2) AS auc, sum((tpr - t0) * precision) AS average_precision FROM d""")
def p28c_areas(spark, sf):
    return ml.areas(_predictions(Tables(spark, sf)))


def _totals(t: Tables):
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("prediction"))
    return t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_totalprice").alias("label"), "prediction")


TOTALS_SQL = """p AS (SELECT o_totalprice AS label, s AS prediction, o_totalprice - s AS e FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey)"""
_AT = (10, 25, 50, 75, 90, 95, 99)


@query("p33b_error_percentiles", f"WITH {TOTALS_SQL} " + " UNION ALL ".join(
    f"SELECT {p} AS percentile, quantile_cont(abs(e), {p / 100}) AS abs_error FROM p" for p in _AT))
def p33b_error_percentiles(spark, sf):
    return ml.error_percentiles(_totals(Tables(spark, sf)))


@query("p33c_errors_by_quartile", f"""WITH {TOTALS_SQL}, q AS (SELECT quantile_cont(label, 0.25) AS q1, quantile_cont(label, 0.5) AS q2,
  quantile_cont(label, 0.75) AS q3 FROM p)
SELECT CASE WHEN label <= q1 THEN 1 WHEN label <= q2 THEN 2 WHEN label <= q3 THEN 3 ELSE 4 END AS quartile, count(*) AS count,
  min(label) AS "from", max(label) AS "to", avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS mean_error FROM p, q GROUP BY 1""")
def p33c_errors_by_quartile(spark, sf):
    return ml.errors_by_quartile(_totals(Tables(spark, sf)))


@query("p33d_class_counts", f"""WITH {PRED_SQL}, l AS (SELECT label AS cls, 1 AS a, 0 AS b FROM p UNION ALL SELECT prediction, 0, 1 FROM p)
SELECT CAST(cls AS VARCHAR) AS cls, sum(a) AS actual, sum(b) AS predicted FROM l WHERE cls IS NOT NULL GROUP BY cls""")
def p33d_class_counts(spark, sf):
    return ml.class_counts(_predictions(Tables(spark, sf)))


@query("n14b_entity_spans")
def n14b_entity_spans(spark, sf):
    return X.entity_spans(Tables(spark, sf).documents, "text", "doc_id")


@query("n14c_entity_counts", "SELECT * FROM (SELECT entity, doc_id, sum(c) AS mentions FROM (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS entity, doc_id, len(regexp_extract_all(text, '(?i){p}')) AS c FROM documents WHERE text IS NOT NULL"
    for kind, patterns in X.SPAN_PATTERNS.items() for p in patterns) + ") GROUP BY ALL) WHERE mentions > 0")
def n14c_entity_counts(spark, sf):
    spans = X.entity_spans(Tables(spark, sf).documents, "text", "doc_id")
    return spans.groupBy("entity", "doc_id").agg(F.count(F.lit(1)).alias("mentions"))


_NUMS_SQL = r"""list_transform(list_filter(list_transform(regexp_extract_all(lower(t), '(\d[\d,]*(?:\.\d+)?\s?[kmb]?)\b', 1),
  lambda s: try_cast(regexp_replace(regexp_replace(s, '[kmb]$', ''), '[,\s]', '', 'g') AS DOUBLE)
    * CASE WHEN s LIKE '%k' THEN 1e3 WHEN s LIKE '%m' THEN 1e6 WHEN s LIKE '%b' THEN 1e9 ELSE 1 END), lambda x: x IS NOT NULL),
  lambda x: printf('%.2f', x))"""


@query("n17b_grounding_in_context", rf"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
n AS (SELECT *, {_NUMS_SQL} AS nums FROM t),
c AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(nums, list_transform(regexp_extract_all(t, '[a-z,]\s([A-Z][a-z]{{3,}})', 1), lambda w: lower(w)))) AS claim
  FROM n WHERE role = 'assistant'),
h AS (SELECT conv_id, turn, unnest(list_concat(nums, regexp_extract_all(lower(t), '([a-z]{{4,}})', 1))) AS claim FROM n),
f AS (SELECT conv_id, claim, min(turn) AS first FROM h GROUP BY ALL),
g AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (WHERE first < turn) AS supported FROM c LEFT JOIN f USING (conv_id, claim) GROUP BY ALL),
b AS (SELECT conv_id, min(turn) AS begun FROM t WHERE t <> '' GROUP BY ALL),
o AS (SELECT t.conv_id, t.turn, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, CAST(CASE WHEN t = '' OR begun IS NULL OR begun >= t.turn THEN 0
  WHEN coalesce(claims, 0) = 0 THEN 70 ELSE supported * 100 // claims END AS INTEGER) AS confidence
  FROM t LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn LEFT JOIN b ON b.conv_id = t.conv_id WHERE role = 'assistant')
SELECT *, confidence >= 50 AS grounded, CASE WHEN supported < claims AND confidence < 30 THEN 'low'
  WHEN supported < claims AND confidence < 60 THEN 'some' END AS warning FROM o""")
def n17b_grounding_in_context(spark, sf):
    return X.grounding_in_context(Tables(spark, sf).conversations)


@query("n21b_user_topics", "SELECT conv_id, topic, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{topic}' AS topic FROM conversations WHERE role = 'user' AND (" + " OR ".join(
        f"contains(lower(text), '{w}')" for w in words) + ")" for topic, words in X.TOPIC_WORDS.items()) + ") GROUP BY ALL")
def n21b_user_topics(spark, sf):
    return X.user_topics(Tables(spark, sf).conversations)


@query("n22b_tfidf_terms", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}_]{2,})', 1) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM w WHERE len(w) >= 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
f AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
v AS (SELECT term, 1 + ln((1 + n) / (1 + df)) AS idf FROM f, n WHERE df >= 2 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 300),
r AS (SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS raw FROM tf JOIN v USING (term))
SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r""")
def n22b_tfidf_terms(spark, sf):
    return X.tfidf_terms(Tables(spark, sf).documents, "text", "doc_id")

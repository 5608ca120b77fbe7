"""Registered queries of selection, transforms, role matching and ensembles
(SURVEY §2.J4, P2, P10, P19, P20, P30)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import ensemble, ml, roles, selection
from kestrel.plans.q_ml import FEATS, labelled_docs
from kestrel.plans.registry import query
from kestrel.session import Tables

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _returned(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINE, (F.col("l_returnflag") == "R").cast("int").alias("returned"))


@query("p10_univariate_selection", """
WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber,
    (l_returnflag = 'R')::INT AS y FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x),
b AS (SELECT *, least(floor((x - min(x) OVER f) / (max(x) OVER f - min(x) OVER f) * 10), 9) AS bin FROM u WINDOW f AS (PARTITION BY feature)),
c AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT feature, sum(n / total * ln(n * total / (nb * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature)::DOUBLE AS total,
    sum(n) OVER (PARTITION BY feature, bin)::DOUBLE AS nb, sum(n) OVER (PARTITION BY feature, y)::DOUBLE AS ny FROM c) GROUP BY feature),
g AS (SELECT feature, y, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS ss FROM u GROUP BY ALL),
a AS (SELECT feature, sum(n)::BIGINT AS rows, (sum(n * (mean - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f_score
  FROM (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM g) GROUP BY feature),
r AS (SELECT feature, corr(x, y) AS correlation FROM u GROUP BY feature)
SELECT feature, rows, mi, f_score, correlation, row_number() OVER (ORDER BY mi DESC, feature)::INT AS mi_rank,
  row_number() OVER (ORDER BY f_score DESC, feature)::INT AS f_rank, row_number() OVER (ORDER BY abs(correlation) DESC, feature)::INT AS correlation_rank
FROM a JOIN m USING (feature) JOIN r USING (feature)""")
def p10_univariate_selection(spark, sf):
    return selection.univariate_scores(_returned(Tables(spark, sf)), LINE, "returned")


@query("p02_quantile_transform", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, rank() OVER (ORDER BY l_quantity) AS lo,
    count(*) OVER (PARTITION BY l_quantity) AS ties, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (lo - 1 + (ties - 1) / 2.0::DOUBLE) / (n - 1) AS quantile FROM r""")
def p02_quantile_transform(spark, sf):
    d = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return selection.quantile_transform(d, "l_quantity").drop("normal_score")


_YJ = """CASE WHEN x >= 0 THEN CASE WHEN p = 0 THEN ln(1 + x) ELSE ((x + 1) ** p - 1) / p END
  ELSE CASE WHEN p = 2 THEN -ln(1 - x) ELSE -((1 - x) ** (2 - p) - 1) / (2 - p) END END"""
_FIT = f"""u AS (SELECT c_custkey, c_acctbal AS x FROM customer), g AS (SELECT (i - 20) / 10.0::DOUBLE AS p FROM range(41) t(i)),
y AS (SELECT p, var_pop({_YJ}) AS v, avg({_YJ}) AS mean, count(*) AS n, sum(sign(x) * ln(1 + abs(x))) AS j FROM u, g GROUP BY p),
b AS (SELECT p, mean, sqrt(v) AS sd FROM y ORDER BY -n / 2.0 * ln(v) + (p - 1) * j DESC, p LIMIT 1)"""


@query("p02b_power_fit", f"WITH {_FIT} SELECT 'c_acctbal' AS \"column\", p AS power, mean, sd FROM b")
def p02b_power_fit(spark, sf):
    return selection.power_fit(Tables(spark, sf).customer, ["c_acctbal"])


@query("p02c_power_transform", f"WITH {_FIT} SELECT c_custkey, ({_YJ} - mean) / sd AS c_acctbal_power FROM u, b")
def p02c_power_transform(spark, sf):
    d = Tables(spark, sf).customer.select("c_custkey", "c_acctbal")
    return selection.power_transform(d, ["c_acctbal"]).drop("c_acctbal")


@query("j04_role_matcher", """
WITH s AS (SELECT avg((l_extendedprice > 0)::INT) > 0.8 AS priced, avg((l_quantity = floor(l_quantity) AND l_quantity > 0 AND l_quantity < 10000)::INT) > 0.8
    AS whole, avg(regexp_matches(l_shipdate::VARCHAR, '^\\d{4}-\\d{2}-\\d{2}')::INT) > 0.5 AS dated FROM lineitem),
p AS (SELECT avg((p_retailprice > 0)::INT) > 0.8 AS priced FROM part)
SELECT 'lineitem' AS "table", 'amount' AS role, 'l_extendedprice' AS "column", 0.8::DOUBLE + CASE WHEN priced THEN 0.15 ELSE 0 END AS score FROM s
UNION ALL SELECT 'lineitem', 'quantity', 'l_quantity', 0.56::DOUBLE + CASE WHEN whole THEN 0.1 ELSE 0 END FROM s
UNION ALL SELECT 'lineitem', 'date', 'l_shipdate', 0.64::DOUBLE + CASE WHEN dated THEN 0.2 ELSE 0 END FROM s
UNION ALL SELECT 'part', 'amount', 'p_retailprice', 0.8::DOUBLE + CASE WHEN priced THEN 0.15 ELSE 0 END FROM p
UNION ALL SELECT 'part', 'customer', 'p_name', 0.72::DOUBLE UNION ALL SELECT 'part', 'category', 'p_type', 0.48::DOUBLE
UNION ALL SELECT 'customer', 'customer', 'c_name', 0.72::DOUBLE UNION ALL SELECT 'customer', 'category', 'c_mktsegment', 0.48::DOUBLE""")
def j04_role_matcher(spark, sf):
    t = Tables(spark, sf)
    return reduce(DataFrame.unionByName, [roles.match_roles(getattr(t, n)).select(F.lit(n).alias("table"), "role", "column", "score")
                                          for n in ("lineitem", "part", "customer")])


@query("j04b_table_profile", """SELECT 'sales_data' AS data_type, 'revenue' AS analysis_mode, count(*) AS rows, 6::BIGINT AS columns,
  floor((1 - sum((p_partkey IS NULL)::INT + (p_name IS NULL)::INT + (p_brand IS NULL)::INT + (p_type IS NULL)::INT + (p_size IS NULL)::INT
    + (p_retailprice IS NULL)::INT) / (count(*) * 6)) * 100)::INT AS completeness, true AS has_amount, true AS has_customer,
  false AS has_product, false AS has_date, false AS has_quantity, true AS has_category, false AS has_region FROM part""")
def j04b_table_profile(spark, sf):
    return roles.table_profile(Tables(spark, sf).part)


def _split_docs(t: Tables) -> DataFrame:
    return labelled_docs(t).withColumn("is_test", ensemble.share_of(F.col("doc_id"), "test-") < 0.2)


_FOLD = "floor(('0x' || substr(md5('fold-' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 3)::INT"


@query("p20_out_of_fold", f"""WITH d AS (SELECT doc_id, quality::DOUBLE AS label, {_FOLD} AS fold FROM labels JOIN documents USING (doc_id)
  WHERE NOT ('0x' || substr(md5('test-' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2)
SELECT doc_id, label, fold, (SELECT count(*) FROM d e WHERE e.fold <> d.fold) AS trained_rows, 2 AS scored FROM d""")
def p20_out_of_fold(spark, sf):
    """Every training row has a score of each model, and of models fitted on the other folds' rows."""
    models = {n: ml.classifiers("label")[n] for n in ("logistic", "decision_tree")}
    rows = ensemble.out_of_fold(_split_docs(Tables(spark, sf)).where("NOT is_test"), "doc_id", FEATS, "label", models)
    count = reduce(lambda a, b: a + b, [F.col(f"oof_{n}").between(0, 1).cast("int") for n in models])
    return rows.select("doc_id", "label", "fold", "trained_rows", count.alias("scored"))


@query("p20b_stacking_leaderboard")
def p20b_stacking_leaderboard(spark, sf):
    return ensemble.stacking(_split_docs(Tables(spark, sf)), "doc_id", FEATS, "label")[1]


def _members(t: Tables) -> dict[str, DataFrame]:
    """Three scorers of quality by rule, so that the vote can be held against SQL."""
    d = t.documents.select("doc_id", "text", "n_chars")
    upper = F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.col("n_chars"), F.lit(1))
    signs = F.regexp_count("text", F.lit("[#$%&*|]"))
    return {"length": d.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 1000.0).alias("score")),
            "capitals": d.select("doc_id", (1.0 - F.least(F.lit(1.0), upper * 10.0)).alias("score")),
            "signs": d.select("doc_id", (1.0 / (1.0 + signs)).alias("score"))}


_VOTE = """s AS (SELECT doc_id, unnest(['length', 'capitals', 'signs']) AS model, unnest([least(1.0, n_chars / 1000.0::DOUBLE),
    1.0 - least(1.0, len(regexp_extract_all(text, '[A-Z]')) / greatest(n_chars, 1)::DOUBLE * 10.0),
    1.0::DOUBLE / (1 + len(regexp_extract_all(text, '[#$%&*|]')))]) AS s FROM documents),
c AS (SELECT model, count(*) FILTER (quality = 1 AND s >= 0.5) AS tp, count(*) FILTER (quality = 0 AND s < 0.5) AS tn,
    count(*) FILTER ((quality = 1) <> (s >= 0.5)) AS wrong FROM s JOIN labels USING (doc_id) GROUP BY model),
f AS (SELECT model, (coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0) + coalesce(2 * tn / nullif(2 * tn + wrong, 0), 0)) / 2 AS macro_f1 FROM c),
w AS (SELECT model, macro_f1, exp(2 * macro_f1) / sum(exp(2 * macro_f1)) OVER () AS weight FROM f)"""


@query("p19_weighted_vote", f"""WITH {_VOTE}, e AS (SELECT doc_id, sum(weight * s) / sum(weight) AS score, count(*) AS members FROM s JOIN w USING (model)
  GROUP BY doc_id) SELECT doc_id, score, members, (score >= 0.5)::INT AS prediction FROM e""")
def p19_weighted_vote(spark, sf):
    t = Tables(spark, sf)
    return ensemble.weighted_vote(_members(t), t.labels, "doc_id", "quality")[0]


@query("p19b_vote_weights", f"WITH {_VOTE} SELECT model, macro_f1, weight FROM w")
def p19b_vote_weights(spark, sf):
    t = Tables(spark, sf)
    return ensemble.weighted_vote(_members(t), t.labels, "doc_id", "quality")[1]


@query("p30_evaluation_gates")
def p30_evaluation_gates(spark, sf):
    return ensemble.gates(labelled_docs(Tables(spark, sf)), "doc_id", FEATS, "label")[0]


@query("p30b_learning_curve", """WITH d AS (SELECT ('0x' || substr(md5('size-' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS size
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL
    AND NOT ('0x' || substr(md5('test-' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2)
SELECT s AS share, count(*) FILTER (size < s) AS rows FROM d, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS s) GROUP BY s""")
def p30b_learning_curve(spark, sf):
    return ensemble.gates(labelled_docs(Tables(spark, sf)), "doc_id", FEATS, "label")[1].select("share", "rows")

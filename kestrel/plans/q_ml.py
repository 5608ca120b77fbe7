"""Registered feature-engineering / model / evaluation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kestrel.operators import ml
from kestrel.operators.text import text_statistics
from kestrel.plans.registry import query
from kestrel.session import Tables

FEATS = ["n_chars", "words", "digit_ratio", "upper_ratio", "sentences"]


def docs_with_features(t: Tables):
    """All documents with numeric text features."""
    st = text_statistics("text")
    d = t.documents.select("doc_id", "source", "n_chars", *[st[k].cast("double").alias(k) for k in FEATS if k != "n_chars"])
    return d.withColumn("n_chars", F.col("n_chars").cast("double"))


def labelled_docs(t: Tables):
    """documents with labels and numeric text features; quality is the label."""
    return docs_with_features(t).join(t.labels, "doc_id").withColumnRenamed("quality", "label").withColumn("label", F.col("label").cast("double"))


PRED_SQL = """p AS (SELECT l.doc_id, quality AS label, 1 - toxic AS prediction, (d.n_chars % 100) / 100.0 AS score
  FROM labels l JOIN documents d USING (doc_id))"""


def _predictions(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"),
        ((F.col("n_chars") % 100) / 100.0).alias("score"))


@query("p01_scaling")
def p01_scaling(spark, sf):
    from pyspark.ml import Pipeline
    d = labelled_docs(Tables(spark, sf))
    m = Pipeline(stages=ml.assembler(FEATS, "robust")).fit(d)
    return m.transform(d).select("doc_id", vector_to_array("features").alias("scaled"))


@query("p03_binning")
def p03_binning(spark, sf):
    from pyspark.ml.feature import QuantileDiscretizer
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return QuantileDiscretizer(numBuckets=5, inputCol="o_totalprice", outputCol="bucket").fit(o).transform(o)


@query("p04_encoding")
def p04_encoding(spark, sf):
    from pyspark.ml import Pipeline
    c = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    m = Pipeline(stages=ml.encode_categoricals(["c_mktsegment"])).fit(c)
    return m.transform(c).select("c_custkey", "c_mktsegment_idx", vector_to_array("c_mktsegment_ohe").alias("ohe"))


@query("p05_target_encoding")
def p05_target_encoding(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"])
    return ml.target_encode(d.where(~F.col("is_test")), d, "source", "label").select("doc_id", "source", "source_te")


@query("p06_rare_grouping")
def p06_rare_grouping(spark, sf):
    return ml.rare_group(Tables(spark, sf).part.select("p_partkey", "p_type"), "p_type", 0.21)


@query("p07_polynomial")
def p07_polynomial(spark, sf):
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    d = labelled_docs(Tables(spark, sf))
    v = VectorAssembler(inputCols=["words", "digit_ratio"], outputCol="v").transform(d)
    return PolynomialExpansion(degree=2, inputCol="v", outputCol="poly").transform(v).select(
        "doc_id", vector_to_array("poly").alias("poly"))


@query("p08_variance_filter")
def p08_variance_filter(spark, sf):
    d = labelled_docs(Tables(spark, sf))
    return d.select("doc_id", *ml.variance_filter(d, FEATS))


@query("p09_correlated_removal")
def p09_correlated_removal(spark, sf):
    d = labelled_docs(Tables(spark, sf))
    return d.select("doc_id", *ml.drop_correlated(d, FEATS))


@query("p11_leakage")
def p11_leakage(spark, sf):
    return ml.leakage(labelled_docs(Tables(spark, sf)), FEATS, "label")


@query("p12_class_weights")
def p12_class_weights(spark, sf):
    return ml.class_weights(labelled_docs(Tables(spark, sf)), "label").select("doc_id", "label", "weight")


@query("p13_pca")
def p13_pca(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA
    d = labelled_docs(Tables(spark, sf))
    m = Pipeline(stages=ml.assembler(FEATS) + [PCA(k=2, inputCol="features", outputCol="pc")]).fit(d)
    return m.transform(d).select("doc_id", vector_to_array("pc").alias("pc"))


@query("p14_split")
def p14_split(spark, sf):
    return ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"], label="label").select("doc_id", "label", "is_test")


@query("p15_classifiers")
def p15_classifiers(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"], label="label")
    return ml.leaderboard(d, FEATS, "label", "classification")[0]


@query("p16_regressors")
def p16_regressors(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"),
                                                           F.sum("l_quantity").alias("qty")),
                      F.col("o_orderkey") == F.col("l_orderkey"))
    o = ml.split(o.select("o_orderkey", "lines", "qty", F.col("o_totalprice").alias("label")), ["o_orderkey"])
    return ml.leaderboard(o, ["lines", "qty"], "label", "regression")[0]


@query("p17_cross_validation")
def p17_cross_validation(spark, sf):
    return ml.cross_validate(labelled_docs(Tables(spark, sf)).select("doc_id", *FEATS, "label"), FEATS, "label")


@query("p21_clustering")
def p21_clustering(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal", "c_nationkey")
    return ml.cluster(c, ["c_acctbal", "c_nationkey"], 4).select("c_custkey", "cluster")


@query("p22_choose_k")
def p22_choose_k(spark, sf):
    c = Tables(spark, sf).customer.select("c_acctbal", "c_nationkey")
    return ml.kmeans_choose_k(c, ["c_acctbal", "c_nationkey"], range(2, 11))


@query("p23_segment_profile")
def p23_segment_profile(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal", "c_nationkey")
    return ml.segment_profile(ml.cluster(c, ["c_acctbal", "c_nationkey"], 4), ["c_acctbal", "c_nationkey"])


@query("p24_batch_scoring")
def p24_batch_scoring(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"], label="label")
    model = ml.leaderboard(d, FEATS, "label", "classification", ["logistic"])[1]["logistic"]
    return ml.to_score(model.transform(docs_with_features(Tables(spark, sf)))).select("doc_id", "prediction", "score")


@query("p25_sensitivity_grid")
def p25_sensitivity_grid(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)).select("doc_id", *FEATS, "label"), ["doc_id"], label="label")
    model = ml.leaderboard(d, FEATS, "label", "classification", ["logistic"])[1]["logistic"]
    return ml.sensitivity_grid(model, d.select(*FEATS), "words", 10)


@query("p26_feature_importance")
def p26_feature_importance(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"], label="label")
    model = ml.leaderboard(d, FEATS, "label", "classification", ["random_forest"])[1]["random_forest"]
    return ml.feature_importance(model, FEATS)


@query("p27_confusion_matrix", f"""WITH {PRED_SQL},
g AS (SELECT label AS actual, prediction AS predicted, count(*) AS count FROM p GROUP BY ALL)
SELECT *, count * 100.0 / sum(count) OVER (PARTITION BY actual) AS row_pct FROM g""")
def p27_confusion_matrix(spark, sf):
    return ml.confusion(_predictions(Tables(spark, sf)))


@query("p28_roc_curve", f"""WITH {PRED_SQL},
g AS (SELECT score AS threshold, sum(label)::DOUBLE AS tp_at, sum(1 - label)::DOUBLE AS fp_at FROM p GROUP BY score),
c AS (SELECT threshold, sum(tp_at) OVER w AS tp, sum(fp_at) OVER w AS fp FROM g
  WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT threshold, tp, fp, tp / (SELECT sum(label) FROM p) AS tpr, fp / (SELECT sum(1 - label) FROM p) AS fpr,
  tp / (tp + fp) AS precision FROM c""")
def p28_roc_curve(spark, sf):
    return ml.roc_points(_predictions(Tables(spark, sf)))


_TH = [round(0.1 + 0.05 * i, 2) for i in range(17)]


@query("p28b_threshold_sweep", f"""WITH {PRED_SQL},
t AS (SELECT unnest([{', '.join(str(x) for x in _TH)}]) AS threshold),
c AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END)::DOUBLE AS tp,
  sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN score < threshold THEN label ELSE 0 END)::DOUBLE AS fn FROM t, p GROUP BY threshold)
SELECT threshold, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) AS f1 FROM c""")
def p28b_threshold_sweep(spark, sf):
    return ml.threshold_sweep(_predictions(Tables(spark, sf)))


@query("p29_regression_errors", """WITH p AS (SELECT o_totalprice AS label, s AS prediction FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey),
e AS (SELECT label, prediction, label - prediction AS e FROM p)
SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(label) * count(*)) AS r2,
  avg(e) AS residual_mean, median(e) AS residual_median, min(e) AS residual_min, max(e) AS residual_max,
  stddev_samp(e) AS residual_std FROM e""")
def p29_regression_errors(spark, sf):
    t = Tables(spark, sf)
    p = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("prediction")),
                      F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_totalprice").alias("label"), "prediction")
    return ml.regression_errors(p)


@query("p32_calibration", f"""WITH {PRED_SQL}
SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, avg(score) AS mean_score, avg(label::DOUBLE) AS observed_rate,
  count(*) AS count FROM p GROUP BY ALL""")
def p32_calibration(spark, sf):
    return ml.calibration(_predictions(Tables(spark, sf)))


@query("p33_per_class_metrics", f"""WITH {PRED_SQL},
cls AS (SELECT label AS cls FROM p UNION SELECT prediction FROM p),
j AS (SELECT cls, (SELECT count(*) FROM p WHERE label = cls AND prediction = cls) AS tp,
  (SELECT count(*) FROM p WHERE label = cls) AS support, (SELECT count(*) FROM p WHERE prediction = cls) AS predicted FROM cls)
SELECT cls, support, tp / predicted AS precision, tp / support AS recall,
  2 * (tp / predicted) * (tp / support) / ((tp / predicted) + (tp / support)) AS f1 FROM j""")
def p33_per_class_metrics(spark, sf):
    return ml.per_class_metrics(_predictions(Tables(spark, sf)))


@query("p34_model_based_selection")
def p34_model_based_selection(spark, sf):
    d = labelled_docs(Tables(spark, sf))
    return d.select("doc_id", *ml.select_top_features(d, FEATS, "label", 3))


@query("p34b_recursive_elimination")
def p34b_recursive_elimination(spark, sf):
    d = ml.split(labelled_docs(Tables(spark, sf)), ["doc_id"], label="label")
    return ml.recursive_elimination(d, FEATS, "label", 2).withColumn("features", F.array_join("features", ","))


@query("p31_model_versions", """SELECT version, 2::BIGINT AS versions, count(*) AS scored, 0::BIGINT AS changed
FROM documents, (SELECT unnest([1, 2])::INT AS version) GROUP BY version""")
def p31_model_versions(spark, sf):
    """Two versions saved and loaded: every document's score before and after."""
    from kestrel.session import scratch_path
    t, folder = Tables(spark, sf), scratch_path(spark, "models")
    d = ml.split(labelled_docs(t), ["doc_id"], label="label")
    docs = docs_with_features(t).select("doc_id", *FEATS)
    parts = []
    for n in (1, 2):
        board, fitted = ml.leaderboard(d, FEATS[:3 + n], "label", "classification", ["logistic"])
        f1 = board.where("metric = 'f1'").first()["value"]
        number = ml.save_version(spark, folder, "quality", fitted["logistic"], FEATS[:3 + n], "f1", f1)
        before = ml.to_score(fitted["logistic"].transform(docs)).select("doc_id", F.col("score").alias("a"))
        after = ml.to_score(ml.load_version(spark, folder, "quality", number).transform(docs)).select("doc_id", F.col("score").alias("b"))
        parts.append(before.join(after, "doc_id").agg(F.lit(number).alias("version"), F.count(F.lit(1)).alias("scored"),
                                                      F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed")))
    saved = ml.versions(spark, folder).where("name = 'quality'").agg(F.count(F.lit(1))).scalar()
    return parts[0].unionByName(parts[1]).select("version", saved.alias("versions"), "scored", "changed")

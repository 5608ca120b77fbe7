"""Feature engineering and models on Spark ML.

Pipelines are fitted on the training split only (the reference fitted before
splitting); splits are hash-stable; evaluation tables are aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as Fe
from pyspark.ml import regression as R
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.windows import ranked
from kestrel.plans.distributed import exact_quantiles, global_rank, stats_scalar, written

SEED = 42


def split(df: DataFrame, key: Sequence[str], test: float = 0.2, label: str | None = None, seed: int = SEED) -> DataFrame:
    """``is_test`` flag from a seeded hash of the key (stable across
    reruns); stratified when ``label`` is given (the hash is ranked inside
    each class on a range scan, so every class keeps its share and none is one task)."""
    h = F.abs(F.xxhash64(F.lit(seed), *[F.col(k) for k in key])) % 1_000_000 / 1_000_000.0
    if label is None:
        return df.withColumn("is_test", h < test)
    cls = F.to_json(F.struct(F.col(label).alias("l")))  # a class of its own for rows without a label
    r = ranked(df.withColumns({"_cls": cls, "_h": h}), ["_h", *key], by=["_cls"])
    place = (F.col("_rn") - F.col("_g0") - 1) / F.greatest(F.col("_gn") - 1, F.lit(1))
    return r.select(*df.columns, (place < test).alias("is_test"))


def assembler(features: Sequence[str], scale: str | None = "standard") -> list:
    """VectorAssembler plus StandardScaler or RobustScaler."""
    st = [Fe.VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    if scale == "robust":
        st.append(Fe.RobustScaler(inputCol="_raw", outputCol="features", withCentering=True))
    elif scale == "standard":
        st.append(Fe.StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    else:
        st.append(Fe.SQLTransformer(statement="SELECT *, _raw AS features FROM __THIS__"))
    return st


def encode_categoricals(cols: Sequence[str], one_hot_max: int = 10) -> list:
    """StringIndexer (alphabetical) and OneHotEncoder (dropLast=False)."""
    st = []
    for c in cols:
        st.append(Fe.StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc", handleInvalid="keep"))
        st.append(Fe.OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=False))
    return st


def target_encode(train: DataFrame, df: DataFrame, col: str, target: str, smoothing: float = 10.0,
                  out: str | None = None) -> DataFrame:
    """P5: (n * mean_c + m * global) / (n + m) learned on ``train``, applied
    to ``df`` (unseen -> global mean)."""
    g = train.agg(F.avg(target)).scalar()
    stats = train.groupBy(col).agg(F.count(F.lit(1)).alias("_n"), F.avg(target).alias("_m"))
    enc = stats.select(col, ((F.col("_n") * F.col("_m") + smoothing * g) / (F.col("_n") + smoothing)).alias("_enc"))
    return df.join(enc, col, "left").withColumn(out or f"{col}_te", F.coalesce("_enc", g)).drop("_enc")


def rare_group(df: DataFrame, col: str, min_share: float = 0.01, other: str = "_OTHER_") -> DataFrame:
    """Values with share < 1 % become ``_OTHER_``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    keep = df.groupBy(col).count().where(F.col("count") / total >= min_share).select(col, F.lit(True).alias("_keep"))
    return df.join(keep, col, "left").withColumn(col, F.when(F.col("_keep"), F.col(col)).otherwise(F.lit(other))).drop("_keep")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = n / (k * n_class) per row (``weightCol``) and the imbalance ratio."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = df.agg(F.count(F.lit(1))).scalar()
    k = cnt.agg(F.count(F.lit(1))).scalar()
    return df.join(F.broadcast(cnt), label).withColumn("weight", n / (k * F.col("_c"))).drop("_c")


def classifiers(label: str = "label") -> dict:
    """The classifier family (binary GBT / LinearSVC; multiclass via OneVsRest)."""
    return {"logistic": C.LogisticRegression(labelCol=label, maxIter=50),
            "random_forest": C.RandomForestClassifier(labelCol=label, numTrees=30, seed=SEED),
            "gbt": C.GBTClassifier(labelCol=label, maxIter=20, seed=SEED),
            "decision_tree": C.DecisionTreeClassifier(labelCol=label, seed=SEED),
            "naive_bayes": C.NaiveBayes(labelCol=label, modelType="gaussian"),
            "mlp": C.MultilayerPerceptronClassifier(labelCol=label, maxIter=60, seed=SEED), "linear_svc": C.LinearSVC(labelCol=label, maxIter=50)}


def regressors(label: str = "label") -> dict:
    """The regressor family."""
    return {"linear": R.LinearRegression(labelCol=label),
            "ridge": R.LinearRegression(labelCol=label, regParam=0.1, elasticNetParam=0.0),
            "lasso": R.LinearRegression(labelCol=label, regParam=0.1, elasticNetParam=1.0),
            "elastic_net": R.LinearRegression(labelCol=label, regParam=0.1, elasticNetParam=0.5),
            "huber": R.LinearRegression(labelCol=label, loss="huber"),
            "poisson": R.GeneralizedLinearRegression(labelCol=label, family="poisson", link="log"),
            "random_forest": R.RandomForestRegressor(labelCol=label, numTrees=30, seed=SEED),
            "gbt": R.GBTRegressor(labelCol=label, maxIter=20, seed=SEED),
            "decision_tree": R.DecisionTreeRegressor(labelCol=label, seed=SEED)}


def classification_scores(pred: DataFrame, label: str) -> dict[str, float]:
    """Weighted F1, accuracy, weighted precision and recall from one count per (label,
    prediction), at most classes squared rows."""
    cells = {(r["y"], r["p"]): r["n"] for r in pred.groupBy(F.col(label).cast("double").alias("y"), F.col("prediction").alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n = sum(cells.values())
    out = dict.fromkeys(("f1", "accuracy", "weightedPrecision", "weightedRecall"), 0.0)
    for c in {y for y, _ in cells}:
        hit, own = cells.get((c, c), 0), sum(v for (y, _), v in cells.items() if y == c)
        said = sum(v for (_, p), v in cells.items() if p == c)
        precision, recall = hit / said if said else 0.0, hit / own
        for k, v in (("f1", 2 * hit / (own + said)), ("accuracy", recall), ("weightedPrecision", precision), ("weightedRecall", recall)):
            out[k] += v * own / n
    return out


def regression_scores(pred: DataFrame, label: str) -> dict[str, float]:
    """R², RMSE and MAE from one aggregate."""
    y, e = F.col(label).cast("double"), F.col(label) - F.col("prediction")
    r = pred.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("ss"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v")).first()
    return {"r2": 1 - r["ss"] / (r["v"] * r["n"]) if r["v"] else 0.0, "rmse": (r["ss"] / r["n"]) ** 0.5, "mae": r["mae"]}


def leaderboard(df: DataFrame, features: Sequence[str], label: str, task: str = "classification",
                models: Sequence[str] | None = None, scale: str | None = "standard") -> tuple[DataFrame, dict]:
    """Fit each model on the train split, score the test split;
    leaderboard (model, metric, value).  The preparation is fitted once and its vectors
    are kept for all fits; a model is judged by one aggregate."""
    spark = df.sparkSession
    df = df.persist()  # many fits and evaluations read the same (derived) features
    tr, te = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    fam = classifiers(label) if task == "classification" else regressors(label)
    names = list(models or fam)
    n_cls = int(tr.agg(F.max(label)).first()[0] or 0) + 1 if task == "classification" else 0
    prepared = Pipeline(stages=assembler(features, scale)).fit(tr)
    train, test = prepared.transform(tr).persist(), prepared.transform(te).persist()
    rows, fitted = [], {}
    for name in names:
        est = fam[name]
        if task == "classification" and name in ("gbt", "linear_svc") and n_cls > 2:
            est = C.OneVsRest(classifier=est, labelCol=label)
        if name == "mlp":
            est = est.setLayers([len(features), 16, 8, max(2, n_cls)])
        model = est.fit(train)
        fitted[name] = PipelineModel([*prepared.stages, model])
        scores = (classification_scores if task == "classification" else regression_scores)(model.transform(test), label)
        rows += [(name, m, float(v)) for m, v in scores.items()]
    for d in (train, test, df):
        d.unpersist()
    return spark.createDataFrame(rows, "model string, metric string, value double"), fitted


def cross_validate(df: DataFrame, features: Sequence[str], label: str, folds: int = 3) -> DataFrame:
    """K-fold CV with a hash fold column and a small parameter grid
    for logistic regression; one row per parameter set with the mean F1."""
    lr = C.LogisticRegression(labelCol=label, maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    base = df.withColumn("fold", (F.abs(F.xxhash64(F.lit(SEED), *[F.col(c) for c in df.columns if c != "is_test"]))
                                  % folds).cast("int"))
    base = written(base, "folds")  # each fold reads it, what makes the features runs once
    cv = CrossValidator(estimator=Pipeline(stages=assembler(features) + [lr]), estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
                        foldCol="fold", parallelism=2, seed=SEED)
    m = cv.fit(base)
    rows = [(float(p[lr.regParam]), float(p[lr.elasticNetParam]), float(s)) for p, s in zip(grid, m.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, f1 double")


def kmeans_choose_k(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11)) -> DataFrame:
    """K-means on scaled numerics for each k; silhouette (squared
    Euclidean, Spark's definition) and inertia per k."""
    prep = Pipeline(stages=assembler(features)).fit(df)
    x = prep.transform(df).select("features").cache()
    rows = []
    for k in ks:
        m = K.KMeans(k=k, seed=SEED).fit(x)
        sil = ClusteringEvaluator().evaluate(m.transform(x))
        rows.append((int(k), float(sil), float(m.summary.trainingCost)))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double")


def bin_edges(df: DataFrame, column: str, n_bins: int = 10, strategy: str = "quantile") -> list[float]:
    """Ascending distinct edges of at most ``n_bins`` bins: exact quantiles (from a range
    scan), equal widths, or halfway between the centres of a one-dimensional k-means, the first
    and last edge being the minimum and maximum.  Nothing for a column without a value."""
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return []
    if strategy == "quantile":
        names = [f"e{i}" for i in range(n_bins + 1)]
        row = exact_quantiles(x, "x", [i / n_bins for i in range(n_bins + 1)], names=names).first()
        edges = [row[n] for n in names]
    elif strategy == "uniform":
        width = (ends["hi"] - ends["lo"]) / n_bins
        edges = [ends["lo"] + i * width for i in range(n_bins)] + [ends["hi"]]
    elif strategy == "kmeans":
        model = Pipeline(stages=[Fe.VectorAssembler(inputCols=["x"], outputCol="features"), K.KMeans(k=n_bins, seed=SEED)]).fit(x)
        centres = sorted(float(c[0]) for c in model.stages[-1].clusterCenters())
        edges = [ends["lo"], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], ends["hi"]]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return sorted(set(edges))


def bin_column(df: DataFrame, column: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """``out``: how many inner edges are at or below the value (bin 0, 1, ...); null stays null."""
    x = F.col(column).cast("double")
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]).cast("array<double>")
    return df.withColumn(out, F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e <= x))))


def cluster(df: DataFrame, features: Sequence[str], k: int, method: str = "kmeans") -> DataFrame:
    """K-means / Gaussian mixture / bisecting k-means assignments."""
    est = {"kmeans": K.KMeans(k=k, seed=SEED), "gmm": K.GaussianMixture(k=k, seed=SEED),
           "bisecting": K.BisectingKMeans(k=k, seed=SEED)}[method]
    return Pipeline(stages=assembler(features) + [est]).fit(df).transform(df).withColumnRenamed("prediction", "cluster")


def segment_profile(clustered: DataFrame, features: Sequence[str], diff: float = 0.1) -> DataFrame:
    """Per cluster size %, feature means and features differing more
    than 10 % from the overall mean (name: high / low)."""
    n = clustered.agg(F.count(F.lit(1))).scalar()
    overall = clustered.agg(*[F.avg(f).alias(f) for f in features])
    o = overall.first()  # one row of feature means
    g = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features])
    flags = [F.when(F.col(f) > float(o[f]) * (1 + diff), F.lit(f + ":high"))
             .when(F.col(f) < float(o[f]) * (1 - diff), F.lit(f + ":low"))
             for f in features]
    return g.withColumn("size_pct", F.col("size") * 100.0 / n).withColumn(
        "distinct_features", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and row % per (actual, predicted)."""
    g = pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    tot = g.groupBy("actual").agg(F.sum("count").alias("_t"))
    return g.join(tot, "actual").withColumn("row_pct", F.col("count") * 100.0 / F.col("_t")).drop("_t")


def roc_points(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC / PR curve points: for each distinct score threshold (desc)
    cumulative TP and FP, TPR, FPR, precision.  Distinct scores are grouped
    first; the cumulative sums run on the (small) per-score table via a
    range-partitioned scan."""
    g = pred.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("double")).alias("tp_at"), F.sum(1 - F.col(label).cast("double")).alias("fp_at"))
    s = stats_scalar(g.agg(F.sum("tp_at").alias("P"), F.sum("fp_at").alias("N")))
    P, N = F.nullif(s["P"], F.lit(0.0)), F.nullif(s["N"], F.lit(0.0))
    r = global_rank(g, [F.desc("threshold")], out="_r", running={"tp_at": "tp", "fp_at": "fp"})
    return r.select("threshold", "tp", "fp", (F.col("tp") / P).alias("tpr"), (F.col("fp") / N).alias("fpr"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def threshold_sweep(pred: DataFrame, label: str = "label", score: str = "score",
                    thresholds: Sequence[float] = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))) -> DataFrame:
    """Precision / recall / F1 at fixed thresholds (0.1 .. 0.9 by 0.05),
    one conditional aggregate per threshold in a single pass."""
    y = F.col(label).cast("double")
    aggs = []
    for i, t in enumerate(thresholds):
        p = (F.col(score) >= t).cast("double")
        aggs += [F.sum(p * y).alias(f"tp{i}"), F.sum(p * (1 - y)).alias(f"fp{i}"), F.sum((1 - p) * y).alias(f"fn{i}")]
    row = pred.agg(*aggs)
    items = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                      F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)]
    x = row.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / (F.col("tp") + F.col("fn"))
    return x.select("threshold", prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec)).alias("f1"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC and PR (Spark's evaluator)."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score)
    return pred.sparkSession.createDataFrame(
        [(float(ev.setMetricName("areaUnderROC").evaluate(pred)), float(ev.setMetricName("areaUnderPR").evaluate(pred)))],
        "auc_roc double, auc_pr double")


def regression_errors(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, R², residual mean / median / min / max / std."""
    e = F.col(label) - F.col(prediction)
    median = exact_quantiles(pred.select(e.alias("e")), "e", [0.5], names=["m"]).select("m").scalar()
    return pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                    (1 - F.sum(e * e) / (F.var_pop(label) * F.count(F.lit(1)))).alias("r2"),
                    F.avg(e).alias("residual_mean"), F.min(e).alias("residual_min"), F.max(e).alias("residual_max"),
                    F.stddev_samp(e).alias("residual_std")).withColumn("residual_median", median)


def error_percentiles(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      at: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """(percentile, abs_error), exact, from a range scan; rows without an error are left out."""
    e = pred.select(F.abs(F.col(label).cast("double") - F.col(prediction)).alias("e"))
    q = exact_quantiles(e, "e", [p / 100 for p in at], names=[f"p{p}" for p in at])
    return q.select(F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("abs_error"))
                                        for p in at])).alias("r")).select("r.*")


def errors_by_quartile(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Errors in the four slices of the target by its quartiles (a value on a bound falls
    in the lower slice): count, MAE, RMSE and mean error (label - prediction) of each that has
    rows.  Rows without a label or prediction are left out."""
    p = pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).select(
        F.col(label).cast("double").alias("y"), (F.col(label).cast("double") - F.col(prediction)).alias("e"))
    q = stats_scalar(exact_quantiles(p, "y", [0.25, 0.5, 0.75], names=["q1", "q2", "q3"]))
    part = F.when(F.col("y") <= q["q1"], 1).when(F.col("y") <= q["q2"], 2).when(F.col("y") <= q["q3"], 3).otherwise(4)
    return p.groupBy(part.alias("quartile")).agg(
        F.count(F.lit(1)).alias("count"), F.min("y").alias("from"), F.max("y").alias("to"), F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean_error"))


def class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(cls, actual, predicted): rows per class as marked and as predicted, zeros included."""
    both = pred.select(F.explode(F.array(F.struct(F.col(label).cast("string").alias("cls"), F.lit(1).alias("a"), F.lit(0).alias("p")),
                                         F.struct(F.col(prediction).cast("string").alias("cls"), F.lit(0).alias("a"),
                                                  F.lit(1).alias("p")))).alias("r"))
    return both.where(F.col("r.cls").isNotNull()).groupBy("r.cls").agg(F.sum("r.a").alias("actual"), F.sum("r.p").alias("predicted"))


def areas(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC (trapezoids, from the origin) and average precision (precision times
    the gain of recall) over the exact curve of ``roc_points``.  Each point's predecessor is the
    row one rank above it, joined by rank, so the scores may all differ.  A single class gives
    nulls."""
    pts = global_rank(roc_points(pred, label, score), [F.desc("threshold")], out="_r")
    prev = pts.select((F.col("_r") + 1).alias("_r"), F.col("tpr").alias("_t"), F.col("fpr").alias("_f"))
    j = pts.join(prev, "_r", "left")
    t0, f0 = F.coalesce("_t", F.lit(0.0)), F.coalesce("_f", F.lit(0.0))
    return j.agg(F.sum((F.col("fpr") - f0) * (F.col("tpr") + t0) / 2).alias("auc"),
                 F.sum((F.col("tpr") - t0) * F.col("precision")).alias("average_precision"))


def calibration(pred: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Ten equal score bins: mean score, observed rate, count."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return pred.groupBy(b.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias(
        "observed_rate"), F.count(F.lit(1)).alias("count"))


def per_class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    classes = pred.select(F.col(label).alias("cls")).union(pred.select(F.col(prediction).alias("cls"))).distinct()
    tp = pred.where(F.col(label) == F.col(prediction)).groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    sup = pred.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    pp = pred.groupBy(F.col(prediction).alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    j = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(pp, "cls", "left").fillna(0)
    prec = F.col("tp") / F.col("predicted")
    rec = F.col("tp") / F.col("support")
    return j.select("cls", "support", prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec)).alias("f1"))


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Normalised importances (trees) or |coefficients| (linear) per raw feature."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        imp = list(last.featureImportances.toArray())
    else:
        coef = last.coefficients.toArray() if hasattr(last, "coefficients") else last.coefficientMatrix.toArray()[0]
        imp = [abs(float(c)) for c in coef]
    imp = [float(v) for v in imp]
    s = float(sum(imp)) or 1.0
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(
        [(f, float(v) / s) for f, v in zip(features, imp)], "feature string, importance double")


def sensitivity_grid(model: PipelineModel, base: DataFrame, feature: str, points: int = 10) -> DataFrame:
    """P25: one baseline row (feature means) swept over ``points`` values of
    one feature between its min and max (exploded grid, then ``transform``)."""
    cols = [c for c in base.columns if c != "is_test"]
    agg = base.agg(*[F.avg(c).alias(c) for c in cols if c != feature],
                   F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    grid = agg.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")).withColumn(
        feature, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)).drop("_lo", "_hi", "_i")
    out = model.transform(grid)
    keep = [feature, "prediction"] + (["probability"] if "probability" in out.columns else [])
    res = out.select(*keep)
    if "probability" in keep:
        res = res.withColumn("probability", vector_to_array("probability")[1])
    return res


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, k: int = 1, least_gain: float | None = None,
                          trees: int = 20) -> DataFrame:
    """(round, dropped, importance, f1, features left): each round fits a random
    forest on the features left, judges it on the test split (``is_test``) and drops the
    least important feature (ties by name), until ``k`` are left; with ``least_gain`` it
    stops earlier, before a round whose F1 falls short of the best so far by more.  The
    last row drops nothing."""
    spark = df.sparkSession
    rows, left, best = [], list(features), 0.0
    df = df.persist()
    while True:
        stages = assembler(left, None) + [C.RandomForestClassifier(labelCol=label, numTrees=trees, seed=SEED)]
        model = Pipeline(stages=stages).fit(df.where(~F.col("is_test")))
        f1 = classification_scores(model.transform(df.where(F.col("is_test"))), label)["f1"]
        importance, worst = min(zip(model.stages[-1].featureImportances.toArray().tolist(), left))
        best = max(best, f1)
        if len(left) <= k or (least_gain is not None and f1 < best - least_gain):
            rows.append((len(rows) + 1, None, None, f1, left))
            break
        rows.append((len(rows) + 1, worst, importance, f1, list(left)))
        left = [f for f in left if f != worst]
    df.unpersist()
    return spark.createDataFrame(rows, "round int, dropped string, importance double, f1 double, features array<string>")


MODEL_ROW = "name string, version int, path string, features array<string>, metric string, value double"


def save_version(spark, folder: str, name: str, model: PipelineModel, features: Sequence[str], metric: str, value: float) -> int:
    """Save a fitted pipeline under the next free version of ``name`` in ``folder`` (a
    path that all executors share) and append its row to the folder's table of versions;
    the row comes last, so a version without one was never finished and is not listed.
    Returns the version, from 1."""
    old = versions(spark, folder).where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
    path = f"{folder.rstrip('/')}/{name}/v{old + 1}"
    model.write().overwrite().save(path)
    spark.createDataFrame([(name, old + 1, path, list(features), metric, float(value))], MODEL_ROW).coalesce(1).write.mode("append").parquet(
        f"{folder.rstrip('/')}/versions")
    return old + 1


def versions(spark, folder: str) -> DataFrame:
    """The saved versions, a row each; none for a folder without any."""
    spark.createDataFrame([], MODEL_ROW).write.mode("append").parquet(f"{folder.rstrip('/')}/versions")
    return spark.read.schema(MODEL_ROW).parquet(f"{folder.rstrip('/')}/versions")


def load_version(spark, folder: str, name: str, version: int | None = None) -> PipelineModel:
    """A saved version, by default the latest."""
    rows = versions(spark, folder).where(F.col("name") == name)
    rows = rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version"))
    row = rows.first()
    if row is None:
        raise ValueError(f"no version {version or ''} of {name} in {folder}")
    return PipelineModel.load(row["path"])


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (versioned path chosen by the caller)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def variance_filter(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Features whose sample variance exceeds ``threshold`` (one aggregate)."""
    row = df.agg(*[F.var_samp(f).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > threshold]


def drop_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Greedily drop the lower-variance feature of every pair with |r| > 0.95."""
    from kestrel.operators.aggregate import correlation_matrix
    pairs = correlation_matrix(df, features).where(F.abs("r") > threshold).collect()  # <= features^2 rows
    var = df.agg(*[F.var_samp(f).alias(f) for f in features]).first()
    dropped = set()
    for p in pairs:
        a, b = p["col_a"], p["col_b"]
        if a in dropped or b in dropped:
            continue
        dropped.add(a if (var[a] or 0) < (var[b] or 0) else b)
    return [f for f in features if f not in dropped]


def leakage(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.95) -> DataFrame:
    """Features with |corr(feature, target)| > 0.95."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "r").withColumn("leak", F.abs("r") > threshold)


def select_top_features(df: DataFrame, features: Sequence[str], label: str, k: int = 5) -> list[str]:
    """Top-k features by random-forest importance."""
    model = Pipeline(stages=assembler(features, None) + [C.RandomForestClassifier(labelCol=label, numTrees=20, seed=SEED)]).fit(df)
    imp = model.stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip(imp, features), key=lambda x: -x[0])][:k]


def to_score(pred: DataFrame) -> DataFrame:
    """Positive-class probability as ``score``."""
    return pred.withColumn("score", vector_to_array("probability")[1])

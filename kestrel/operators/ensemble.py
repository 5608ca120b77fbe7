"""Stacking, weighted voting and evaluation gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml.base import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ml import SEED, assembler, classifiers
from kestrel.session import scratch_path


def share_of(key: Column, salt: str = "") -> Column:
    """A number from 0 to 1 (not 1) by the MD5 of the key: the same in every run and engine."""
    text = F.concat(F.lit(salt), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def fold_of(key: Column, folds: int) -> Column:
    return F.floor(share_of(key, "fold-") * folds).cast("int")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: many fits read it, and a lost executor re-reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def probability(pred: DataFrame) -> Column:
    """The score of class 1 of a fitted binary model's output, from 0 to 1."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))


def scored(rows: DataFrame, fitted: dict, prefix: str) -> DataFrame:
    """``rows`` plus one column per model, row by row: no join."""
    keep = list(rows.columns)
    for name, model in fitted.items():
        out = model.transform(rows)
        rows = out.select(*[F.col(f"`{c}`") for c in keep], probability(out).alias(prefix + name))
        keep.append(prefix + name)
    return rows


def fit_all(rows: DataFrame, features: Sequence[str], models: dict[str, Estimator]) -> dict:
    return {n: Pipeline(stages=assembler(features) + [e]).fit(rows) for n, e in models.items()}


def out_of_fold(train: DataFrame, key: str, features: Sequence[str], label: str, models: dict[str, Estimator],
                folds: int = 3) -> DataFrame:
    """P20: ``train``'s key, label, fold, the number of rows that its fold's models were
    trained on, and ``oof_<model>``: the prediction of a model fitted on the other folds.
    Rows without a label are left out."""
    rows = _written(train.where(F.col(label).isNotNull()).select(key, *features, F.col(label).cast("double").alias(label),
                                                                 fold_of(F.col(key), folds).alias("fold")), "folds")
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per fold
    parts = []
    for k in sorted(sizes):
        seen = rows.where(F.col("fold") != k)
        part = scored(rows.where(F.col("fold") == k), fit_all(seen, features, models), "oof_")
        parts.append(part.withColumn("trained_rows", F.lit(sum(sizes.values()) - sizes[k]).cast("long")))
    return reduce(DataFrame.unionByName, parts).drop(*features)


def quality(rows: DataFrame, label: str, columns: dict[str, str], at: float = 0.5) -> DataFrame:
    """Per scored column its accuracy, macro and weighted F1 at a threshold: one unpivoted
    aggregate over all models.  A class that is never seen nor predicted does not count."""
    long = rows.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), (F.col(c) >= at).cast("int").alias("p")) for n, c in columns.items()])).alias("m"))
    cells = long.groupBy("m.model").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if((F.col("y") == y) & (F.col("m.p") == p)).alias(f"c{y}{p}") for y in (0, 1) for p in (0, 1)])
    f1, size = [], []
    for y in (0, 1):
        hit, wrong = F.col(f"c{y}{y}"), F.col(f"c{y}{1 - y}") + F.col(f"c{1 - y}{y}")
        f1.append(F.when(2 * hit + wrong > 0, 2 * hit / (2 * hit + wrong)))
        size.append(F.col(f"c{y}0") + F.col(f"c{y}1"))
    known = F.when(f1[0].isNull(), f1[1]).when(f1[1].isNull(), f1[0]).otherwise((f1[0] + f1[1]) / 2)
    weighted = (F.coalesce(f1[0], F.lit(0.0)) * size[0] + F.coalesce(f1[1], F.lit(0.0)) * size[1]) / F.col("n")
    return cells.select("model", F.col("n").alias("rows"), ((F.col("c00") + F.col("c11")) / F.col("n")).alias("accuracy"),
                        known.alias("macro_f1"), weighted.alias("weighted_f1"))


BASE = ("logistic", "random_forest", "decision_tree")


def stacking(df: DataFrame, key: str, features: Sequence[str], label: str, names: Sequence[str] = BASE,
             folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """P20: (test scores, leaderboard) of the base models, their soft vote and the stack.

    The meta model, a logistic regression, learns from out-of-fold predictions only; the
    base models are then fitted on all training rows.  ``df`` has ``is_test``."""
    models = {n: e for n, e in classifiers(label).items() if n in names}
    train, test = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    meta_rows = _written(out_of_fold(train, key, features, label, models, folds), "oof")
    meta = Pipeline(stages=assembler([f"oof_{n}" for n in models], None) + [C.LogisticRegression(labelCol=label, maxIter=100)]).fit(meta_rows)
    fitted = fit_all(_written(train.select(key, *features, F.col(label).cast("double").alias(label)), "train"), features, models)
    rows = scored(test.select(key, *features, label), fitted, "oof_")
    rows = scored(rows, {"stacking": meta}, "")
    vote = reduce(lambda a, b: a + b, [F.col(f"oof_{n}") for n in models]) / len(models)
    rows = _written(rows.withColumn("soft_vote", vote).withColumnsRenamed({f"oof_{n}": n for n in models}).drop(*features), "scores")
    return rows, quality(rows, label, {n: n for n in [*models, "soft_vote", "stacking"]})


def weighted_vote(members: dict[str, DataFrame], truth: DataFrame, key: str, label: str = "label", score: str = "score",
                  at: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(ensemble, weights).  Every member is a table (key, score); its weight is
    exp(2 x macro F1 against ``truth``), normalised.  The tables are stacked, not joined:
    one aggregate by key adds up the members, however many there are; a key that some
    lack is scored by those that have it."""
    long = reduce(DataFrame.unionByName, [d.select(key, F.lit(n).alias("model"), F.col(score).cast("double").alias("s")) for n, d in members.items()])
    long = long.where(F.col("s").isNotNull())
    known = long.join(truth.select(key, F.col(label).cast("int").alias("y")).where("y IS NOT NULL"), key)
    counts = known.groupBy("model").agg(*[F.count_if((F.col("y") == y) & ((F.col("s") >= at).cast("int") == p)).alias(f"c{y}{p}")
                                          for y in (0, 1) for p in (0, 1)])
    wrong = F.col("c01") + F.col("c10")
    f1 = (F.coalesce(F.try_divide(2 * F.col("c00"), 2 * F.col("c00") + wrong), F.lit(0.0))
          + F.coalesce(F.try_divide(2 * F.col("c11"), 2 * F.col("c11") + wrong), F.lit(0.0))) / 2
    raw = counts.select("model", f1.alias("macro_f1"), F.exp(2 * f1).alias("w"))
    weights = raw.select("model", "macro_f1", (F.col("w") / raw.agg(F.sum("w")).scalar()).alias("weight"))  # one row per member
    out = long.join(weights, "model").groupBy(key).agg((F.sum(F.col("weight") * F.col("s")) / F.sum("weight")).alias("score"),
                                                       F.count(F.lit(1)).alias("members"))
    return out.withColumn("prediction", (F.col("score") >= at).cast("int")), weights


# fixed values: the bounds of the gates
GAP, LEAST_CV, CV_SPREAD, STABLE, NOISE = 0.15, 0.5, 0.05, 0.7, 0.1


def gates(df: DataFrame, key: str, features: Sequence[str], label: str, model: str = "logistic", folds: int = 5,
          shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(gates, learning curve) of a binary classifier.

    Gates (value, bound, passed): overfitting, the accuracy on the training rows less
    that on the test rows; cross_validation, the mean weighted F1 of ``folds`` folds;
    cv_stability, its deviation; robustness, the share of all rows whose prediction
    stays when every feature gets seeded normal noise.  Learning curve: accuracy of
    models fitted on nested samples of the training rows, by hash of the key."""
    rows = _written(df.where(F.col(label).isNotNull()).select(
        key, *features, F.col(label).cast("double").alias(label), fold_of(F.col(key), folds).alias("fold"),
        (share_of(F.col(key), "test-") < 0.2).alias("is_test"), share_of(F.col(key), "size-").alias("size")), "gates")
    est = {model: classifiers(label)[model]}
    train = rows.where("NOT is_test")
    curve = []
    for s in shares:
        fitted = fit_all(train.where(F.col("size") < s), features, est)
        both = scored(rows.where(F.col("is_test") | (F.col("size") < s)), fitted, "p_")
        right = ((F.col("p_" + model) >= 0.5).cast("double") == F.col(label)).cast("double")
        curve.append(both.agg(F.lit(float(s)).alias("share"), F.count_if(~F.col("is_test")).alias("rows"),
                              F.avg(F.when(~F.col("is_test"), right)).alias("train_accuracy"),
                              F.avg(F.when(F.col("is_test"), right)).alias("test_accuracy")))
    curve = _written(reduce(DataFrame.unionByName, curve), "curve")
    oof = out_of_fold(rows.drop("fold"), key, features, label, est, folds)
    cv = reduce(DataFrame.unionByName, [quality(oof.where(F.col("fold") == k), label, {str(k): "oof_" + model}) for k in range(folds)])
    cv = cv.agg(F.avg("weighted_f1").alias("mean"), F.stddev_pop("weighted_f1").alias("sd"))
    noisy = rows.select(key, *[(F.col(c).cast("double") + NOISE * F.randn(SEED + i)).alias(c) for i, c in enumerate(features)])
    plain = scored(rows.select(key, *features), fitted, "p_").select(key, (F.col("p_" + model) >= 0.5).alias("a"))
    moved = scored(_written(noisy, "noise"), fitted, "p_").select(key, (F.col("p_" + model) >= 0.5).alias("b"))
    stable = plain.join(moved, key).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("v"))
    last = curve.where(F.col("share") == float(max(shares))).select((F.col("train_accuracy") - F.col("test_accuracy")).alias("v"))
    table = [(last, "overfitting", "v", GAP, True), (cv, "cross_validation", "mean", LEAST_CV, False),
             (cv, "cv_stability", "sd", CV_SPREAD, True), (stable, "robustness", "v", STABLE, False)]
    out = [d.select(F.lit(n).alias("gate"), F.col(v).alias("value"), F.lit(b).alias("bound"),
                    (F.col(v) <= b if most else F.col(v) >= b).alias("passed")) for d, n, v, b, most in table]
    return reduce(DataFrame.unionByName, out), curve

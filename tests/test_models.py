"""Selection, transforms, role matching, stacking, voting and gates on literal rows."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ensemble, ml, roles, selection


# ---- univariate selection ------------------------------------------------------------------------

def test_scores_of_known_columns(spark):
    rows = [(float(i % 10), float(i % 2), 7.0, None if i % 3 else float(i), "ab"[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, y string")
    got = {r.feature: r for r in selection.univariate_scores(d, ["a", "b", "c", "d"], "y").collect()}
    assert got["b"].mi == pytest.approx(math.log(2)) and got["a"].mi == pytest.approx(math.log(2))
    assert got["b"].f_score is None and got["c"].mi == 0 and got["c"].f_score is None  # no spread within, none at all
    assert got["d"].rows == 67 and got["a"].rows == 200 and got["a"].correlation is None
    assert (got["a"].mi_rank, got["b"].mi_rank) == (1, 2) and got["c"].mi_rank == 4
    assert selection.select_k_best(d, ["a", "b", "c", "d"], "y", 2) == ["a", "b"]


def test_f_and_correlation_by_hand(spark):
    d = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (6.0, 1), (9.0, None)], "x double, y int")
    r = selection.univariate_scores(d, ["x"], "y").first()
    assert r.rows == 4 and r.f_score == pytest.approx(12.25 / (2.5 / 2)) and r.correlation == pytest.approx(3.5 / math.sqrt(14.75))
    assert selection.univariate_scores(d.limit(0), ["x"], "y").collect() == []


# ---- transforms ----------------------------------------------------------------------------------

def test_normal_scores_of_ranks(spark):
    xs = [5.0, 1.0, 5.0, 3.0, None, 9.0]
    got = selection.quantile_transform(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), "x")
    q = {r.i: (r.quantile, r.normal_score) for r in got.collect()}
    want = {0: 0.625, 1: 0.0, 2: 0.625, 3: 0.25, 5: 1.0}
    for i, p in want.items():
        assert q[i][0] == p and q[i][1] == pytest.approx(NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)
    assert q[4] == (None, None)


def test_power_equals_a_plain_grid(spark):
    rng = random.Random(2)
    cols = {"skew": [math.exp(rng.gauss(0, 1)) for _ in range(400)], "both": [rng.gauss(0, 2) ** 3 for _ in range(400)], "flat": [3.0] * 400}
    d = spark.createDataFrame(list(zip(*cols.values())), "skew double, both double, flat double")

    def yj(x, p):
        if x >= 0:
            return math.log1p(x) if p == 0 else ((x + 1) ** p - 1) / p
        return -math.log1p(-x) if p == 2 else -((1 - x) ** (2 - p) - 1) / (2 - p)

    got = {r.column: r for r in selection.power_fit(d, list(cols)).collect()}
    for c in ("skew", "both"):
        def fit(p):
            y = [yj(x, p) for x in cols[c]]
            m = sum(y) / len(y)
            return -len(y) / 2 * math.log(sum((v - m) ** 2 for v in y) / len(y)) + (p - 1) * sum(math.copysign(math.log1p(abs(x)), x) for x in cols[c])
        assert got[c].power == max(selection.GRID, key=fit)
    assert got["flat"].power is None
    out = selection.power_transform(d, list(cols)).agg(F.avg("skew_power").alias("m"), F.stddev_pop("skew_power").alias("s"), F.max("flat_power").alias("f")).first()
    assert out.m == pytest.approx(0, abs=1e-9) and out.s == pytest.approx(1) and out.f == 0


# ---- roles ---------------------------------------------------------------------------------------

def test_each_form_of_name_and_value(spark):
    assert roles.name_score("Revenue", "amount") == 1.0 and roles.name_score("net revenue x", "amount") == 0.8
    assert roles.name_score("shipped_at", "date") == pytest.approx(0.7 * 0.8) and roles.name_score("zzz", "amount") == 0
    assert roles.name_score("quantty", "quantity") == pytest.approx(14 / 15 * 0.6 * 0.7)
    d = spark.createDataFrame([(f"{i % 9 + 1}", f"${i}.50", f"2024-01-{i % 28 + 1:02d}", "nan" if i % 2 else f"c{i}", " ") for i in range(40)],
                              "units string, price string, day_date string, client string, city string")
    got = {r.role: (r.column, round(r.score, 4)) for r in roles.match_roles(d).collect()}
    assert got == {"quantity": ("units", 0.8), "amount": ("price", 1.0), "date": ("day_date", 0.84), "customer": ("client", 0.9), "region": ("city", 0.6)}


def test_a_role_and_a_column_count_once(spark):
    d = spark.createDataFrame([(1.0, 2.0, "a", "b", None)], "total double, price double, client_name string, company string, order_id string")
    got = roles.match_roles(d).collect()
    assert len({r.role for r in got}) == len(got) == len({r.column for r in got})
    assert {r.role: r.column for r in got} == {"amount": "total", "customer": "client_name"}  # of equal scores the first column
    p = roles.table_profile(d).first()
    assert (p.data_type, p.analysis_mode, p.rows, p.columns, p.completeness, p.has_date) == ("sales_data", "revenue", 1, 5, 80, False)


def test_roles_of_an_empty_table(spark):
    d = spark.createDataFrame([], "amount double, note string")
    assert [(r.role, r.column, r.score) for r in roles.match_roles(d).collect()] == [("amount", "amount", 1.0)]
    assert roles.table_profile(d).first().completeness is None


# ---- ensembles -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((i, a, b, float(a + b > 0) if rng.random() > 0.05 else float(a + b <= 0)))
    return spark.createDataFrame(out, "id long, a double, b double, label double").withColumn("is_test", ensemble.share_of(F.col("id"), "t") < 0.25).cache()


def test_no_row_is_scored_by_a_model_that_saw_it(spark, rows):
    models = {"logistic": ml.classifiers()["logistic"]}
    oof = {r.id: r for r in ensemble.out_of_fold(rows, "id", ["a", "b"], "label", models).collect()}
    assert len(oof) == 400 and {r.fold for r in oof.values()} == {0, 1, 2}
    for k in range(3):  # refit by hand without the fold: its scores come out
        own = rows.where(ensemble.fold_of(F.col("id"), 3) == k)
        rest = rows.where(ensemble.fold_of(F.col("id"), 3) != k)
        again = ensemble.scored(own, ensemble.fit_all(rest, ["a", "b"], models), "p_").collect()
        assert len(again) == sum(r.fold == k for r in oof.values()) and {oof[r.id].trained_rows for r in again} == {rest.count()}
        assert all(oof[r.id].oof_logistic == pytest.approx(r.p_logistic, abs=1e-4) for r in again)


def test_stacking_leaderboard(rows):
    scores, board = ensemble.stacking(rows, "id", ["a", "b"], "label", ["logistic", "decision_tree"])
    got = {r.model: r for r in board.collect()}
    assert set(got) == {"logistic", "decision_tree", "soft_vote", "stacking"} and got["stacking"].accuracy > 0.85
    table = scores.collect()
    right = sum((r.stacking >= 0.5) == (r.label == 1) for r in table)
    assert got["stacking"].accuracy == pytest.approx(right / len(table)) and got["stacking"].rows == len(table)


def test_weighted_vote_by_hand(spark):
    truth = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None)], "id int, label int")
    good = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.8), (4, 0.6)], "id int, score double")
    bad = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None)], "id int, score double")
    out, weights = ensemble.weighted_vote({"good": good, "bad": bad}, truth, "id")
    w = {r.model: r.weight for r in weights.collect()}
    assert w["good"] == pytest.approx(math.exp(2) / (math.exp(2) + 1)) and sum(w.values()) == pytest.approx(1)
    got = {r.id: (r.score, r.members, r.prediction) for r in out.collect()}
    assert got[1] == (pytest.approx(0.9 * w["good"] + 0.2 * w["bad"]), 2, 1) and got[3] == (0.8, 1, 1) and got[4] == (0.6, 1, 1)


def test_gates(rows):
    table, curve = ensemble.gates(rows, "id", ["a", "b"], "label")
    got = {r.gate: r for r in table.collect()}
    assert set(got) == {"overfitting", "cross_validation", "cv_stability", "robustness"}
    assert got["overfitting"].passed and got["cross_validation"].value > 0.85 and got["robustness"].value > 0.9
    assert all(r.passed == (r.value <= r.bound if g in ("overfitting", "cv_stability") else r.value >= r.bound) for g, r in got.items())
    sizes = [r.rows for r in sorted(curve.collect(), key=lambda r: r.share)]
    assert sizes == sorted(sizes) and len(sizes) == 4


# ---- samples, leaderboards, elimination, versions ------------------------------------------------

@pytest.mark.parametrize("sizes, mode", [({"a": 300, "b": 33, None: 17}, "stratified"), ({"a": 40, "b": 3}, "uniform")])
def test_stratified_sample_is_exact(spark, sizes, mode):
    from kestrel.sources.files import stratified_sample
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    got = stratified_sample(spark.createDataFrame(rows, "id string, c string"), "c", 0.1, ["id"]).collect()
    assert len(got) == round(len(rows) * 0.1) and {r._sample_mode for r in got} == {mode} and len({r.id for r in got}) == len(got)
    if mode == "stratified":
        assert {c: sum(r.c == c for r in got) for c in sizes} == {"a": 30, "b": 3, None: 2}  # 35 x 300, 33 and 17 / 350: 30, 3.3, 1.7
    assert stratified_sample(spark.createDataFrame([], "id string, c string"), "c", 0.1, ["id"]).count() == 0


def test_scores_equal_the_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    rng = random.Random(1)
    d = spark.createDataFrame([(float(rng.randrange(3)), float(rng.randrange(4))) for _ in range(200)], "label double, prediction double")
    for m, v in ml.classification_scores(d, "label").items():
        assert v == pytest.approx(MulticlassClassificationEvaluator(labelCol="label", metricName=m).evaluate(d))
    for m, v in ml.regression_scores(d, "label").items():
        assert v == pytest.approx(RegressionEvaluator(labelCol="label", metricName=m).evaluate(d))


def test_elimination_drops_the_noise_first(spark, rows):
    d = rows.withColumn("noise", F.rand(3))
    got = ml.recursive_elimination(d, ["a", "noise", "b"], "label").orderBy("round").collect()
    assert got[0].dropped == "noise" and {got[1].dropped, *got[2].features} == {"a", "b"} and got[2].dropped is None
    assert [len(r.features) for r in got] == [3, 2, 1]
    assert len(ml.recursive_elimination(d, ["a", "noise", "b"], "label", least_gain=-1.0).collect()) == 1


def test_versions_round_trip(spark, rows, tmp_path):
    fitted = ml.leaderboard(rows, ["a", "b"], "label", models=["logistic", "mlp"])[1]
    folder = str(tmp_path)
    assert ml.versions(spark, folder).count() == 0
    with pytest.raises(ValueError):
        ml.load_version(spark, folder, "m")
    assert [ml.save_version(spark, folder, "m", fitted[n], ["a", "b"], "f1", 0.5) for n in ("logistic", "mlp")] == [1, 2]
    assert ml.save_version(spark, folder, "other", fitted["mlp"], ["a"], "f1", 0.5) == 1
    for version, n in ((1, "logistic"), (None, "mlp")):
        a, b = (sorted((r.id, r.probability[1]) for r in m.transform(rows).collect()) for m in (fitted[n], ml.load_version(spark, folder, "m", version)))
        assert a == b


def test_sma_of_zero(spark):
    from kestrel.operators import series
    d = spark.createDataFrame([(i, y) for i, y in enumerate([0.0, 0.0, 0.0, 3.0, -2.0, -1.0])], "t int, y double")
    r = series.sma_signal(d).first()
    assert r.sma == 0 and r.deviation_pct == 0 and r.signal == "neutral" and r.next_values == [0.0] * 5
    up = series.sma_signal(spark.createDataFrame([(i, float(i)) for i in range(6)], "t int, y double")).first()
    assert up.next_values[0] == up.next_value and up.next_values[4] == pytest.approx(up.sma + 5 * (up.next_value - up.sma))

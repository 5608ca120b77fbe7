"""Bands, violins, extremes, degrees, slices, spans, grounding and term weights on literal rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kestrel.operators import aggregate, charts, ml
from kestrel.operators import graph as G
from kestrel.operators import text as X


def test_extremes_of_categories(spark):
    rows = [(c,) for c, n in (("a", 40), ("b", 3), ("c", 3), ("d", 2), ("e", 3), ("f", 3), ("g", 3)) for _ in range(n)] + [(None,)]
    got = {(r.kind, r.category): r.n for r in aggregate.category_extremes(spark.createDataFrame(rows, "c string"), "c").collect()}
    assert got == {("top", "a"): 40, ("top", "b"): 3, ("bottom", "d"): 2, ("bottom", "g"): 3, ("high", "a"): 40}
    few = spark.createDataFrame([("a",), ("b",)], "c string")
    assert aggregate.category_extremes(few, "c").count() == 0 and aggregate.category_extremes(few.limit(0), "c").count() == 0


def test_band_counts_nulls_as_zero_and_leaves_the_rest(spark):
    d = spark.createDataFrame([(i, None if i == 1 else float(i)) for i in range(7)], "k int, v double")
    got = charts.confidence_band(d, "v", ["k"], 3).orderBy("point").collect()
    assert [(r.point, r.mean, r.upper - r.mean) for r in got] == [(1, 0.0, 0.0), (2, 2.5, 0.5), (3, 4.5, 0.5)]  # 6 is left over
    assert charts.confidence_band(d, "v", ["k"], 30).count() == 7 and charts.confidence_band(d.limit(0), "v", ["k"]).count() == 0


def test_violin_and_bullet(spark):
    d = spark.createDataFrame([("a", float(i), 2.0) for i in range(5)] + [("b", 7.0, None), ("b", 7.0, None), ("z", 1.0, 1.0)], "c string, x double, t double")
    got = {r.category: r for r in charts.violin(d, "c", "x", top=2, bins=2).collect()}
    assert sorted(got) == ["a", "b"] and (got["a"].q1, got["a"].median, got["a"].q3) == (1.0, 2.0, 3.0)
    assert [tuple(s) for s in got["a"].shape] == [(0, 2), (1, 3)] and [tuple(s) for s in got["b"].shape] == [(0, 2)]
    last = charts.bullet(d, "x", "t", ["c", "x"]).first()
    assert (last.value, last.target, last.axis_end) == (1.0, 1.0, 1.2)
    b = charts.bullet(d.where("c = 'b'"), "x", "t", ["c"]).first()
    assert b.target == pytest.approx(7.7) and charts.bullet(d.limit(0), "x", "t", ["c"]).first().value == 0.0


def test_degrees_and_revenue_table(spark):
    nodes = spark.createDataFrame([("invoice:1", "invoice", "1", 5.0), ("invoice:2", "invoice", "2", None), ("invoice:3", "invoice", "3", None),
                                   ("customer:x", "customer", "x", None), ("date:d", "date", "d", None)], "id string, type string, label string, amount double")
    edges = spark.createDataFrame([("invoice:1", "customer:x"), ("invoice:2", "customer:x"), ("invoice:3", "date:d"), ("gone", "customer:x")], "src string, dst string")
    deg = {r.id: (r.out_degree, r.in_degree, r.degree) for r in G.degrees(nodes, edges).collect()}
    assert deg["customer:x"] == (0, 3, 3) and deg["invoice:1"] == (1, 0, 1) and "gone" not in deg
    got = {r.invoice: (r.customer, r.product, r.date, r.amount) for r in G.revenue_table(nodes, edges).collect()}
    assert got == {"invoice:1": ("x", "General Item", "Unknown Date", 5.0), "invoice:2": ("x", "General Item", "Unknown Date", 0.0)}


def test_areas_against_all_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.4), (1, 0.4), (0, 0.1), (0, 0.1)]
    got = ml.areas(spark.createDataFrame(rows, "label int, score double")).first()
    pairs = [(p, n) for lp, p in rows if lp for ln, n in rows if not ln]
    assert got.auc == pytest.approx(sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs))
    assert got.average_precision == pytest.approx((1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))
    assert ml.areas(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().auc is None


def test_error_slices(spark):
    d = spark.createDataFrame([(float(i), float(i) - 1 if i > 4 else float(i)) for i in range(1, 9)] + [(None, 1.0)], "label double, prediction double")
    got = {r.quartile: (r["count"], r.mae, r.mean_error) for r in ml.errors_by_quartile(d).collect()}
    assert got == {1: (2, 0.0, 0.0), 2: (2, 0.0, 0.0), 3: (2, 1.0, 1.0), 4: (2, 1.0, 1.0)}
    assert {r.percentile: r.abs_error for r in ml.error_percentiles(d, at=(50, 90)).collect()} == {50: 0.5, 90: 1.0}


def test_a_split_keeps_every_class_and_rows_without_one(spark):
    rows = [(i, ["a", "b", None][min(2, i // 80)]) for i in range(200)]
    got = ml.split(spark.createDataFrame(rows, "k int, c string"), ["k"], 0.25, "c").groupBy("c").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {r.c: (r.n, r.t) for r in got} == {"a": (80, 20), "b": (80, 20), None: (40, 10)}


def test_spans_have_offsets_in_code_points(spark):
    text = "🙂 paid $1,200.50 (12 USD), 5% on 2024-01-05 or Jan 5, 2024; 3 items last week"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {(r.entity, r.value): (r.start, r.end) for r in X.entity_spans(d, "text", "id").collect()}
    assert all(text[a:b] == v for (_, v), (a, b) in got.items())
    assert {k for k in got} == {("money", "$1,200.50"), ("money", "12 USD"), ("percentage", "5%"), ("date", "2024-01-05"),
                                ("date", "Jan 5, 2024"), ("date", "last week"), ("quantity", "3 items")}


def test_grounding_looks_at_every_earlier_turn(spark):
    rows = [(1, 1, "user", "we sold 1.5k units in berlin"), (1, 2, "assistant", "so 1500 units in Berlin, and 70 in Paris"),
            (1, 3, "user", "ok"), (1, 4, "assistant", "as said, Paris had 70"), (1, 5, "assistant", "nothing to claim"),
            (2, 1, "assistant", "we have 5"), (2, 2, "assistant", None)]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.claims, r.supported, r.confidence, r.grounded, r.warning) for r in X.grounding_in_context(d).collect()}
    assert got[(1, 2)] == (4, 2, 50, True, "some") and got[(1, 4)] == (2, 2, 100, True, None)
    assert got[(1, 5)] == (0, 0, 70, True, None) and got[(2, 1)] == (1, 0, 0, False, "low") and got[(2, 2)][2] == 0


def test_term_weights_against_plain_python(spark):
    texts = ["red red apple pie", "red apple", "green apple", "", None, "apple x y"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.term): r.weight for r in X.tfidf_terms(d, "text", "id", vocab=10, min_df=2, max_df=0.9).collect()}
    idf = {"apple": 1 + math.log(7 / 5), "red": 1 + math.log(7 / 3), "red apple": 1 + math.log(7 / 3)}
    for i, tf in ((0, {"red": 2, "apple": 1, "red apple": 1}), (1, {"red": 1, "apple": 1, "red apple": 1}), (2, {"apple": 1}), (5, {"apple": 1})):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got.pop((i, t)) == pytest.approx(v / size)
    assert not got


def test_bins_by_three_strategies(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 50.0, 51.0, 100.0)] + [(None,)], "x double")
    assert ml.bin_edges(d, "x", 2, "uniform") == [0.0, 50.0, 100.0] and ml.bin_edges(d, "x", 2) == [0.0, 26.0, 100.0]
    edges = ml.bin_edges(d, "x", 3, "kmeans")
    got = {r.x: r.bin for r in ml.bin_column(d, "x", edges).collect()}
    assert [got[x] for x in (0.0, 1.0, 2.0, 50.0, 51.0, 100.0, None)] == [0, 0, 0, 1, 1, 2, None]
    assert ml.bin_edges(d.limit(0), "x") == [] and ml.bin_edges(d.where("x = 1"), "x", 4) == [1.0]
    assert {r.bin for r in ml.bin_column(d.where("x = 1"), "x", [1.0]).collect()} == {0}


def test_the_floored_forecast_goes_on(spark):
    p = spark.createDataFrame([(0, 30.0), (1, 20.0), (2, 10.0), (3, 0.0)], "t int, y double")
    from kestrel.operators import series
    assert [r.forecast for r in series.exp_blend_forecast(p, 3).orderBy("step").collect()] == [0.0, 0.0, 0.0]


def test_preview_and_parsed_order(spark):
    from kestrel.operators import frame
    d = spark.createDataFrame([(3, "$1,000"), (2, "$5"), (1, "$5"), (4, "none")], "k int, v string")
    assert [r.k for r in frame.sort_by_parsed(d, "v", tie_breaker=["k"]).collect()] == [3, 1, 2, 4]
    assert [r.k for r in frame.preview(d, 2, 1, order=["v"]).collect()] == [3, 1]

"""Carried values, as-of joins, distinct counts and repair on literal rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import frame, profile, quality, windows
from kestrel.plans.distributed import carry_last, distinct_counts

D = dt.datetime


def plain_fill(rows):
    """rows (group, place, value) -> {place: last value at or before it in the group}."""
    out, last = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last[g] = v if v is not None else last.get(g)
        out[k] = last[g]
    return out


@pytest.mark.parametrize("seen", [0.5, 0.01, 0.0])
def test_one_group_over_all_tasks_with_long_empty_runs(spark, seen):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), k, float(k) if rnd.random() < seen else None) for k in range(800)]
    d = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r.k: r.f for r in carry_last(d, ["g"], ["k"], "v", "f", partitions=13).collect()}
    assert got == plain_fill(rows)
    back = {r.k: r.v for r in windows.fill(d, "v", ["k"], ["g"], direction="backward").collect()}
    assert back == {-k: v for k, v in plain_fill([(g, -k, v) for g, k, v in rows]).items()}


def test_fill_without_groups_and_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    assert [r.v for r in windows.fill(d, "v", ["k"]).orderBy("k").collect()] == [None, "x", "x"]
    assert windows.fill(d.limit(0), "v", ["k"]).collect() == []


def test_asof_equals_plain_search_when_one_user_has_most_events(spark):
    rnd = random.Random(5)
    left = [(rnd.choice(["u"] * 5 + ["w", None]), rnd.randrange(300), i) for i in range(500)]
    right = [(rnd.choice(["u"] * 5 + ["w", None]), t, rnd.choice([None, 1.0, 2.0])) for t in rnd.sample(range(300), 120)]
    L = spark.createDataFrame(left, "user string, t int, i int")
    R = spark.createDataFrame(right, "user string, t int, v double")
    got = {r.i: (r.t_right, r.v) for r in frame.asof_join(L, R, ["user"], "t", "t", ["t", "v"]).collect()}
    want = {}
    for u, t, i in left:
        before = [(rt, v) for ru, rt, v in right if u is not None and ru == u and rt <= t]
        want[i] = max(before, key=lambda x: x[0]) if before else (None, None)  # a null of the latest row stays
    assert got == want


def test_asof_ties_take_the_largest_row_and_null_times_match_nothing(spark):
    L = spark.createDataFrame([("a", 5), ("a", None), ("a", 5)], "_b0 string, _t int")
    R = spark.createDataFrame([("a", 5, 1), ("a", 5, 3), ("a", None, 9)], "_b0 string, ts int, v int")
    got = frame.asof_join(L, R, ["_b0"], "_t", "ts", ["v"]).collect()
    assert sorted((str(r._t), r.v) for r in got) == [("5", 3), ("5", 3), ("None", None)]
    assert frame.asof_join(L, R.limit(0), ["_b0"], "_t", "ts", ["v"]).where("v IS NOT NULL").count() == 0


def test_distinct_counts(spark):
    rows = [(1, 0.0, "a", [1]), (1, -0.0, None, [1]), (2, float("nan"), "", None), (None, float("nan"), "a", [2])]
    d = spark.createDataFrame(rows, "`x.y` int, value double, `column` string, n array<int>")
    got = {r.column: (r.rows, r.nulls, r.distinct) for r in distinct_counts(d, d.columns).collect()}
    assert got == {"x.y": (4, 1, 2), "value": (4, 0, 2), "column": (4, 1, 2), "n": (4, 1, 2)}
    assert {tuple(r)[1:] for r in distinct_counts(d.limit(0), d.columns).collect()} == {(0, 0, 0)}


def test_a_hint_of_two_letters_is_a_word(spark):
    d = spark.createDataFrame([(i, float(i), float(i)) for i in range(30)], "order_id int, paid double, width double")
    got = {r.column: r.role for r in profile.column_roles(d).collect()}
    assert got["order_id"] == "id" and got["paid"] != "id" and got["width"] != "id"


def test_kinds_of_values_and_score_of_an_empty_table(spark):
    rows = [("yes", "1.5", 1.0), ("12", "2", None), ("2024-01-05", None, 2.0), ("word", "3", 2.0)]
    d = spark.createDataFrame(rows, "mixed string, number string, typed double")
    got = {r.column: (r.kinds, r.consistent) for r in quality.type_consistency(d).collect()}
    assert got == {"mixed": (4, False), "number": (2, True), "typed": (2, True)}
    assert quality.quality_score_weighted(d.limit(0)).first().score == 0.0


def test_dates_are_filled_both_ways_and_empty_columns_dropped(spark):
    rows = [(1, None, None, 1.0), (2, D(2024, 1, 2), None, None), (3, None, None, 3.0), (4, D(2024, 1, 4), "x", 5.0)]
    d = spark.createDataFrame(rows, "k int, day timestamp, rare string, v double")
    got = quality.auto_impute(d, order=["k"], aggressive=True, skip_pct=50).orderBy("k").collect()
    assert [r.day.day for r in got] == [2, 2, 2, 4] and [r.v for r in got] == [1.0, 3.0, 3.0, 5.0]
    assert [r.rare for r in got] == ["x"] * 4  # 75 % missing: filled when aggressive, below the 80 % that drop
    assert [r.rare for r in quality.auto_impute(d).orderBy("k").collect()] == [None, None, None, "x"]
    plan = {r.column: r.strategy for r in quality.impute_plan(d.withColumn("none", F.lit(None).cast("string")), True).collect()}
    assert plan == {"day": "ffill+bfill", "rare": "mode", "v": "median", "none": "drop"}


def test_units_are_read_above_sixty_percent(spark):
    d = spark.createDataFrame([("1k", "1k"), ("2m", "word"), ("n/a", "x y"), ("4", "z")], "a string, b string")
    got = quality.type_repair(d)
    assert dict(got.dtypes) == {"a": "double", "b": "string"} and [r.a for r in got.collect()] == [1e3, 2e6, None, 4.0]


def test_auto_fix_log_and_enrichment(spark):
    rows = [(i, D(2024, 1, 1 + i % 20), float(i), 2) for i in range(20)] + [(3, D(2024, 1, 4), 3.0, 2)]
    d = spark.createDataFrame(rows, "id int, sale_date timestamp, price double, quantity int")
    fixed, log = quality.auto_fix(d)
    got = {(r.step, r.column): r.rows for r in log.collect()}
    assert got[("dedupe", "*")] == 1 and got[("enrich", "sale_year")] == 20 and got[("enrich", "total_value")] == 20
    monday = fixed.where("id = 0").first()
    assert (monday.sale_day_of_week, monday.sale_is_weekend, fixed.count()) == (0, False, 20)


def test_all_columns_are_capped_and_filled_from_one_scan(spark):
    d = spark.createDataFrame([(float(i), 1.0, None if i == 0 else float(i % 2)) for i in range(101)] + [(1e6, 1.0, float("inf"))],
                              "a double, b double, c double")
    got = quality.cap_outliers(d, ["a", "b"]).agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    assert got.a < 100 and got.b == 1.0
    assert quality.replace_inf_drop_constant(d).columns == ["a", "c"]
    assert quality.impute(d.limit(0), {"a": "median"}).collect() == []
    none = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r.x for r in quality.impute(quality.cap_outliers(none, ["x"]), {"x": "median"}).collect()] == [None, None]

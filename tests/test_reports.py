"""Schema, dashboard, overview and report tables on literal rows."""

import datetime as dt

import pytest

from kestrel.operators import overview, reports, schema

D = dt.datetime


def cells(df):
    return {(r.section, r.item, r.measure): r.value for r in df.collect()}


SALES = [(D(2024, 1, 5), 100.0, "ann", "p1"), (D(2024, 1, 9), 50.0, "bob", "p2"), (D(2024, 2, 1), 30.0, "ann", "p1"),
         (D(2024, 2, 2), None, "cy", "p3"), (D(2024, 2, 3), 45.0, None, None), (None, 7.0, "bob", "p2")]
SCHEMA = "date timestamp, amount double, customer string, product string"


# ---- schema --------------------------------------------------------------------------------------

def test_schema_columns_and_summary(spark):
    rows = [(1, "a", 2.0, D(2024, 1, 1), True), (2, None, float("nan"), None, True), (2, None, float("nan"), None, True)]
    d = spark.createDataFrame(rows, "user_id int, kind string, price double, seen timestamp, flag boolean")
    got = {r.column: r for r in schema.schema_columns(d).collect()}
    assert got["user_id"].category == "identifier" and not got["user_id"].is_dimension and not got["user_id"].is_metric
    assert (got["kind"].missing, got["kind"].distinct, got["kind"].is_dimension) == (2, 1, False)
    assert (got["price"].missing, got["price"].mean, got["price"].is_metric) == (2, 2.0, True)  # NaN is missing
    assert got["seen"].is_time and not got["flag"].is_time
    s = schema.schema_summary(d).first()
    assert (s.rows, s.columns, s.missing, s.duplicates, s.time_column) == (3, 5, 6, 1, "seen")
    assert s.completeness == pytest.approx(1 - 6 / 15)


def test_schema_of_an_empty_table_and_clashing_names(spark):
    d = spark.createDataFrame([], "`a.b` int, position string, `column` double, value string")
    got = schema.schema_columns(d).collect()
    assert sorted(r.column for r in got) == ["a.b", "column", "position", "value"] and all(r.distinct == 0 for r in got)
    s = schema.schema_summary(d).first()
    assert (s.rows, s.missing, s.duplicates, s.completeness) == (0, 0, 0, None)


def test_only_the_first_metrics_count(spark):
    d = spark.createDataFrame([tuple(float(i + j) for j in range(12)) for i in range(20)], [f"total{j}" for j in range(12)])
    got = {r.column: r.is_metric for r in schema.schema_columns(d, first=3).collect()}
    assert [c for c, m in got.items() if m] == ["total0", "total1", "total2"]


def test_domain():
    assert schema.domain(["campaign", "clicks", "channel"])[0] == "marketing"
    assert schema.domain(["x", "y"]) == ("general", 0.5)
    assert schema.domain(["patient", "doctor"]) == ("healthcare", 0.4)


# ---- dashboard -----------------------------------------------------------------------------------

def test_dashboard_by_hand(spark):
    got = cells(reports.dashboard_stats(spark.createDataFrame(SALES, SCHEMA), "date", "amount", "customer", "product"))
    assert got["totals", "all", "revenue"] == 232 and got["totals", "all", "orders"] == 6
    assert got["totals", "all", "customers"] == 3 and got["totals", "all", "products"] == 3
    assert got["abc_customer", "ann", "rank"] == 1 and got["abc_customer", "ann", "total"] == 130
    assert got["abc_customer", "ann", "grade_no"] == 1 and got["abc_customer", "bob", "cumulative_pct"] == pytest.approx(100)
    assert got["tier_customer", "Champions/ann", "count"] == 2
    assert got["timeline", "2024-02", "revenue"] == 75 and got["timeline", "2024-02", "customers"] == 2
    assert got["timeline", "2024-02", "orders"] == 3
    assert got["growth_pct", "last_month", "revenue"] == pytest.approx(-50)
    assert got["growth_pct", "last_month", "customers"] == 0 and got["growth_pct", "last_month", "orders"] == pytest.approx(50)
    assert got["findings", "customers", "top3_customers_pct"] == pytest.approx(100)


def test_dashboard_of_nothing_and_of_one_month(spark):
    none = cells(reports.dashboard_stats(spark.createDataFrame([], SCHEMA), "date", "amount", "customer", "product"))
    assert none["totals", "all", "orders"] == 0 and none["totals", "all", "revenue"] == 0
    one = cells(reports.dashboard_stats(spark.createDataFrame(SALES[:2], SCHEMA), "date", "amount", "customer", "product"))
    assert not [k for k in one if k[0] == "growth_pct"]  # nothing to compare with


# ---- overview ------------------------------------------------------------------------------------

def test_roles_and_numbers_in_texts(spark):
    rows = [(f"{i:03}x", f"${1000 + i:,}.5", "red" if i % 2 else "blue", f"2024-01-{i % 28 + 1:02}", "long text %d" % (i % 60))
            for i in range(120)]
    d = spark.createDataFrame(rows, "ref string, charge string, colour string, day string, note string")
    got = {r.column: r for r in overview.overview_roles(d).collect()}
    assert [got[c].role for c in d.columns] == ["identifier", "metric", "dimension", "time", "text"]
    assert got["charge"].total == pytest.approx(sum(1000.5 + i for i in range(120))) and got["colour"].total is None


def test_overview_by_hand(spark):
    rows = [("a", "x", D(2024, 1, 1 + i), 10.0 * (i + 1)) for i in range(4)] + [("b", None, None, None)]
    d = spark.createDataFrame(rows, "team string, kind string, day timestamp, amount double")
    got = cells(overview.unified_overview(d))
    assert got["kpis", "Total Amount", "value"] == 100 and got["kpis", "Total Records", "value"] == 5
    assert got["kpis", "Total Amount", "change_pct"] == pytest.approx((35 - 15) / 15 * 100)
    assert got["trend", "a/2024-01-03", "mean"] == 30 and got["comparison", "b", "total"] == 0  # null counts 0
    assert got["crosstab", "a/x", "count"] == 4 and ("crosstab", "b/x", "count") not in got
    assert got["spread", "amount", "median"] == 20 and got["ranked", "1. a", "amount"] == 40
    assert got["slicers", "team=a", "n"] == 4


def test_overview_of_odd_tables(spark):
    for rows, kinds in (([], "team string, day timestamp, amount double"), ([(None, None, None)], "team string, day timestamp, amount double"),
                        ([("a",)], "name string"), ([(1.0,)], "amount double"), ([("v", "s")], "value string, section string")):
        got = cells(overview.unified_overview(spark.createDataFrame(rows, kinds)))
        assert got["kpis", "Total Records", "value"] == len(rows)


# ---- reports -------------------------------------------------------------------------------------

def test_metrics_and_anomalies(spark):
    d = spark.createDataFrame([(i, float(i), 1.0 if i < 29 else 100.0) for i in range(30)], "k int, x double, y double")
    m = cells(reports.metrics_report(d.select("x", "y", "k"), ["k"]))
    assert m["half_change_pct", "x", "change"] == pytest.approx((22 - 7) / 7 * 100)
    assert sum(v for k, v in m.items() if k[0] == "histogram_x" and k[2] == "count") == 30
    a = cells(reports.anomaly_report(d.select("y", "x")))
    assert a["z_score", "y", "anomalies"] == 1 and a["z_score", "all", "anomalies"] == 1 and a["box", "y", "outside"] == 1


def test_breakdown_and_summary(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0), ("b", 5.0)], "c string, x double")
    b = cells(reports.breakdown_report(d, top=1))
    assert b["columns", "c", "distinct"] == 2 and b["columns", "c", "present"] == 4
    assert b["values", "c=a", "n"] == 2 and ("values", "c=b", "n") not in b and b["mean_x_by_c", "b", "mean"] == 5
    s = cells(reports.summary_report(d))
    assert s["overview", "table", "quality_score"] == pytest.approx(100 - 20 - 10) and s["missing", "c", "missing"] == 1


def test_period_summary_and_texts(spark):
    d = spark.createDataFrame(SALES, SCHEMA)
    p = cells(reports.period_summary(d, "date", "amount", "customer", "product", 7, 2))
    assert p["totals", "period", "revenue"] == 75 and p["totals", "period", "orders"] == 3
    assert p["totals", "period", "growth_pct"] == 0  # nothing in the seven days before
    assert p["weeks", "2024-02-04", "revenue"] == 75 and p["customers", "ann", "rank"] == 1
    t = {(r.chunk, r.line): r.text for r in reports.summary_texts(d, "date", "amount", "customer", "product", "$").collect()}
    assert t["summary", 2] == "Total Revenue: $232.00" and t["top_customers", 1] == "1. ann: $130.00 (2 orders)"
    assert t["bottom_customers", 1] == "1. cy: $0.00 (1 orders)" and t["months", 2] == "2024-02: $75.00 (3 orders)"
    e = cells(reports.enterprise_report(d, "amount", "customer", "product", top=1))
    assert e["concentration", "customers", "top_customers_pct"] == pytest.approx(130 / 232 * 100)


def test_reports_of_empty_and_zero_tables(spark):
    empty = spark.createDataFrame([], "c string, x double, d timestamp")
    assert cells(reports.summary_report(empty))["overview", "table", "rows"] == 0
    assert cells(reports.breakdown_report(empty)) == {}
    assert cells(reports.anomaly_report(empty))["z_score", "all", "anomalies"] == 0
    assert cells(reports.enterprise_report(spark.createDataFrame([], SCHEMA), "amount", "customer", "product"))["totals", "all", "orders"] == 0
    zero = spark.createDataFrame([(D(2024, 1, 1), 0.0, "a", "p")], SCHEMA)
    got = cells(reports.dashboard_stats(zero, "date", "amount", "customer", "product"))
    assert got["abc_customer", "a", "share_pct"] == 0 and got["abc_customer", "a", "grade_no"] == 1
    assert cells(reports.enterprise_report(zero, "amount", "customer", "product"))["customers", "a", "share_pct"] == 0

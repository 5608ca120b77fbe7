"""A slice of the driver's correctness gate: Spark query vs DuckDB SQL at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.session import TABLE_NAMES

SF = "/root/testdata/sf0.001"
NAMES = ["a11_sql_text_query", "d01_group_aggregate", "d16_percentiles_shape", "e04_abc_grade_customers",
         "e06b_moving_average_by_customer", "e18_forward_fill", "h05_parse_money", "i04_rule_checks",
         "j03_schema_columns", "k01_cohort_retention", "k14_dashboard_stats", "k15_unified_overview", "k18_metrics_report",
         "o02_knn_cosine", "p28_roc_curve", "q07_sankey",
         "m10_bfs_paths", "m15_type_subgraph", "r01b_sliding_rate_stream", "r02_sessions_stream", "r06_dedupe_stream"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _order(row):
    return repr(tuple(f"{v:.4g}" if isinstance(v, float) else repr(v) for v in row))


def _same(x, y):
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(_same(i, j) for i, j in zip(x, y))
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)
    return x == y or (x is None and y is None) or (str(x) == str(y))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sp = E.queries()[name](spark, SF).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sp.to_dict("records")), key=_order)
    b = sorted((tuple(_norm(r[c]) for c in cols) for r in dd.to_dict("records")), key=_order)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert _same(x, y), (x, y)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "grade" in df.columns

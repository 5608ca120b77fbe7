"""Invariants and hand-computed fixtures for order-dependent and iterative operators."""

import math

from pyspark.sql import functions as F

from kestrel.operators import graph as G
from kestrel.operators import text as X
from kestrel.operators import windows as W
from kestrel.plans.distributed import exact_quantiles, global_rank

SF = "/root/testdata/sf0.001"


def test_global_rank_is_a_permutation(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    r = global_rank(o, ["o_orderdate", "o_orderkey"], out="rn", partitions=5)
    n = o.count()
    agg = r.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first()
    assert tuple(agg) == (1, n, n)


def test_exact_quantiles_match_pandas(spark):
    import pandas as pd
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 3, 7, 2]], "v double")
    q = exact_quantiles(df, "v", [0.25, 0.5, 0.9]).first()
    s = pd.Series([5, 1, 9, 3, 7, 2], dtype=float)
    assert [q["p25"], q["p50"], q["p90"]] == [s.quantile(0.25), s.quantile(0.5), s.quantile(0.9)]


def test_forward_fill_by_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("b", 1, None), ("b", 2, 5.0), ("b", 3, None)],
                               "g string, t int, v double")
    out = {(r.g, r.t): r.v for r in W.fill(df, "v", ["t"], by=["g"]).collect()}
    assert out == {("a", 1): 1.0, ("a", 2): 1.0, ("a", 3): 1.0, ("b", 1): None, ("b", 2): 5.0, ("b", 3): 5.0}


def test_moving_average_blocks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "t int, v double")
    out = {r.t: r.moving_avg for r in W.moving_average(df, "v", ["t"], window=3).collect()}
    assert out[1] is None and out[2] is None and out[3] == 2.0 and out[10] == 9.0


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("iso",)], "id string")
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "a", "r", 1.0), ("a", "d", "r", 3.0)],
                                  "src string, dst string, relation string, weight double")
    pr = {r.id: r.rank for r in G.pagerank(nodes, edges, iterations=40).collect()}
    assert math.isclose(sum(pr.values()), 1.0, rel_tol=1e-6)
    assert pr["iso"] < pr["a"]


def test_shortest_path_prefers_light_detour(spark):
    edges = spark.createDataFrame([("a", "c", "r", 10.0), ("a", "b", "r", 1.0), ("b", "c", "r", 1.0)],
                                  "src string, dst string, relation string, weight double")
    p = G.shortest_path(edges, "a", "c").first()
    assert p.dist == 2.0 and list(p.path) == ["a", "b", "c"]


def test_sentence_chunks_cover_text():
    text = ("First sentence here. " * 60 + "\n\nNext paragraph starts. Another one!") .strip()
    chunks = X.chunk_document(text, size=200, min_size=50)
    assert chunks and all(len(c["text"]) <= 200 + 60 for c in chunks)
    assert chunks[0]["char_start"] == 0 and chunks[-1]["char_end"] == len(text)


def test_markdown_tables():
    md = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    cells = X.markdown_tables_doc(md)
    assert {(c["row_index"], c["column"], c["value"]) for c in cells} == {(0, "a", "1"), (0, "b", "2"), (1, "a", "3"), (1, "b", "4")}


def test_concentration_counts_every_entity(spark):
    from kestrel.operators.aggregate import concentration
    df = spark.createDataFrame([(f"c{i:03d}", float(1 + i % 7)) for i in range(200)], "c string, v double")
    total = sum(1 + i % 7 for i in range(200))
    shares = sorted(((1 + i % 7) / total * 100 for i in range(200)), reverse=True)
    got = concentration(df, "c", "v").first()
    assert math.isclose(got["hhi"], sum(x * x for x in shares)) and math.isclose(got["cr8"], sum(shares[:8]))
    assert got["leader"] == "c006" and math.isclose(got["leader_share"], shares[0])
    assert math.isclose(concentration(df, "c", "v", hhi_top=50).first()["hhi"], sum(x * x for x in shares[:50]))


def test_cooccurrence_takes_every_column(spark):
    from kestrel.operators.profile import cooccurrence
    df = spark.createDataFrame([tuple("abcde")] * 3, "v string, w string, x string, y string, z string")
    assert cooccurrence(df, list("vwxyz")).count() == 10


def test_segments_are_all_there_for_a_merge(spark):
    from kestrel.operators.kpi import root_cause_segments
    df = spark.createDataFrame([(f"s{i % 20}", float(i % 20)) for i in range(200)], "s string, v double")
    assert root_cause_segments(df, "v", ["s"], threshold=0.01, top=None).count() == 20


def test_issue_report_counts_distinct_values_exactly(spark):
    from kestrel.operators.quality import issue_report
    df = spark.range(5000).select(F.concat(F.lit("v"), (F.col("id") % 4760).cast("string")).alias("s"))
    got = {r["issue"]: r["value"] for r in issue_report(df).where("column = 's'").collect()}
    assert got["high_cardinality"] == 4760 and math.isclose(got["id_like"], 95.2)


def test_queries_take_all_rows(spark):
    import __spark_entry__ as E
    q, docs = E.queries(), spark.read.parquet(f"{SF}/documents.parquet")
    assert q["p24_batch_scoring"](spark, SF).count() == docs.count() > spark.read.parquet(f"{SF}/labels.parquet").count()
    assert [r["k"] for r in q["p22_choose_k"](spark, SF).orderBy("k").collect()] == list(range(2, 11))
    longest = {r["doc_id"] for r in docs.orderBy(F.desc("n_chars"), "doc_id").limit(10).collect()}
    assert longest <= {r["doc_id"] for r in q["o10_hybrid_keyword"](spark, SF).collect()}
    users = q["r04b_tumbling_users_stream"](spark, SF)
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").agg(
        F.count_distinct("user_id").alias("users"))
    assert {(r["d"], r["event_type"], r["users"]) for r in want.collect()} == \
        {(r["window_start"].date(), r["event_type"], r["users"]) for r in users.collect()}


def test_column_mentions_per_turn(spark):
    from kestrel.operators import text as X
    d = spark.createDataFrame([(1, 1, "the Order Date, orderdate"), (1, 2, "ORDER_DATE and revenue"), (1, 3, None), (2, 1, "")],
                              "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn, r.column): (r.form, r.offset, r.end)
           for r in X.column_mentions(d, "text", ["conv_id", "turn"], ["order_date", "revenue"]).collect()}
    assert got == {(1, 1, "order_date"): ("order date", 5, 14), (1, 2, "order_date"): ("order_date", 1, 10),
                   (1, 2, "revenue"): ("revenue", 16, 22)}


def test_links_of_a_page_and_a_malformed_one(spark):
    from kestrel.operators import text as X
    html = "<a href='https://a.example/1'>x</a><a href='https://a.example/1'>y</a><a href='https://b.exa mple/|'>z</a><a href='http://[x'>w</a>"
    pages = spark.createDataFrame([(1, "https://p.example/", html), (2, "u", None)], "page_id int, url string, html string")
    got = [(r.link_index, r.domain) for r in X.page_links(X.extract_pages(pages)).orderBy("link_index").collect()]
    assert got == [(0, "a.example"), (1, None)]


def test_group_medians(spark):
    from kestrel.operators.aggregate import group_aggregate
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 4.0, 3), ("b", 5.0, 3), ("c", None, 4), (None, 7.0, 5)],
                              "k string, x double, y int")
    got = {r.k: (r.x_median, r.x_sum, r.y_median) for r in group_aggregate(d, ["k"], {"x": ["median", "sum"], "y": "median"}).collect()}
    assert got == {"a": (2.0, 12.0, 1.0), "b": (4.5, 9.0, 3.0), "c": (None, 0.0, 4.0)}
    assert None in {r.k for r in group_aggregate(d, ["k"], {"x": "median"}, drop_null_keys=False).collect()}
    assert group_aggregate(d, [], {"x": "median"}).collect() == [(4.5,)]
    assert group_aggregate(d.limit(0), ["k"], {"x": "median"}).collect() == []

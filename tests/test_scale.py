"""Work that has to spread over tasks or stay small: rows as before, and the plan or the calls that show it."""

from pyspark.sql import functions as F

from kestrel.operators import frame
from kestrel.operators import text as X


def test_join_of_repeated_keys_is_dealt_among_tasks(spark):
    left = spark.range(200).select(F.col("id").alias("a"), (F.col("id") % 2).alias("k")).union(
        spark.createDataFrame([(7, None), (7, None)], "a long, k long")).coalesce(1)
    right = spark.range(100).select(F.col("id").alias("b"), (F.col("id") % 2).alias("k"))
    got = frame.join_tables(left, right, ["k"], ["k"], spread=True)
    assert sorted(got.collect()) == sorted(frame.join_tables(left, right, ["k"], ["k"]).collect())
    assert got.count() == 200 * 50
    wide = frame.join_tables(left, F.broadcast(right), ["k"], ["k"], spread=True)
    assert wide.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def test_terms_counted_by_words_first(spark):
    """Runs of rare words are left out of the count; the vocabulary is that of all runs."""
    from collections import Counter
    texts = {i: " ".join(f"w{(i * j) % 7}" for j in range(1, 30)) + f" only{i} rare{i % 9} rare{i % 5}" for i in range(40)}
    rows = [*texts.items(), (3, "w1 w1 w2 twice"), (3, "twice w1 w2"), (None, "w1"), (41, None)]  # a key of three rows, none, no text
    d = spark.createDataFrame(rows, "k long, text string")
    words = d.where("k IS NOT NULL").selectExpr("k", "split(coalesce(text, ''), ' ') AS w")
    for vocab in (5, 12, 1000):  # with 1000 there are fewer terms than asked for
        total, keys = Counter(), {}
        for k, t in rows:
            w = (t or "").split(" ") if k is not None else []
            for term in [*w, *(a + " " + b for a, b in zip(w, w[1:]))]:
                total[term] += 1
                keys.setdefault(term, set()).add(k)
        want = sorted(((t, len(keys[t]), c) for t, c in total.items() if 2 <= len(keys[t]) <= 0.9 * 41), key=lambda r: (-r[2], r[0]))[:vocab]
        got = [tuple(r) for r in X.frequent_terms(words, "w", vocab, 2, 0.9, 2, "k").collect()]
        assert sorted(got) == sorted(want)


def test_tfidf_takes_the_terms_of_count_vectorizer(spark):
    from pyspark.ml.feature import CountVectorizer
    d = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 5}x y{i % 3}" for j in range(9)) + f" lone{i}") for i in range(30)], "k long, text string")
    m = X.tfidf(d, "text", vocab=60)
    terms = m.transform(d)
    old = CountVectorizer(inputCol="_terms", outputCol="c", vocabSize=60, minDF=2.0, maxDF=0.9).fit(terms)
    new = [s for s in m.stages if hasattr(s, "vocabulary")][0]
    assert sorted(new.vocabulary) == sorted(old.vocabulary)
    from unittest import mock
    with mock.patch.object(CountVectorizer, "fit", side_effect=AssertionError("counts all terms of all rows")):
        X.tfidf(d, "text", vocab=20)


def _looks(df, at="Range ("):
    """How often the plan of ``df`` reads its source, subqueries included."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(at)


def _sales(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("invoice"), F.concat(F.lit("c"), (i % 9).cast("string")).alias("customer"), (i % 11).alias("product"),
        F.when(i % 50 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("timestamp")).alias("date"),
        F.when(i % 40 != 0, i * 1.5).alias("amount"), F.when(i % 3 != 0, F.lit("12.5")).otherwise(F.lit(None)).alias("paid"))


def test_roles_and_best_columns_look_once(spark):
    from kestrel.operators import profile
    d = _sales(spark)
    roles = profile.column_roles(d)
    assert _looks(roles) == 1
    got = {r.column: (r.role, r.column_type, r.distinct, r.num_share, r.date_share, r.avg_len) for r in roles.collect()}
    assert got["amount"][:3] == ("amount", "numeric", 390) and got["customer"] == ("entity", "categorical", 9, 0.0, 0.0, 2.0)
    assert got["paid"][1] == "numeric" and got["paid"][2:] == (1, 1.0, 0.0, 4.0) and got["date"][0] == "date"
    best = profile.best_columns(roles, d)
    assert _looks(best) == 1
    assert {r.role: (r.column, r.score) for r in best.collect()} == {
        "amount": ("amount", sum(i * 1.5 for i in range(400) if i % 40)), "date": ("date", 392.0)}


def test_joined_rows_are_written_before_many_looks(spark):
    from kestrel.operators import graph, kpi, reports
    d = _sales(spark)
    nodes, edges = graph.star_graph(d, "invoice", "customer", "product", "date", amount="amount")
    stats = graph.graph_stats(nodes, edges)
    assert _looks(nodes) + _looks(edges) == 0 and stats.first()["isolated_pct"] == 0
    assert nodes.count() == 400 + 9 + 11 + nodes.where("type = 'date'").count()
    assert _looks(reports.dashboard_stats(d, "date", "amount", "customer", "product")) == 0
    assert _looks(reports.metrics_report(d, ["invoice"])) == 0
    assert _looks(kpi.kpi_cards(d, "date", "amount", ["invoice"])) == 0


def test_sales_join_moves_lines_once(spark, tmp_path):
    from kestrel.plans.common import sales
    from kestrel.session import Tables
    spark.createDataFrame([(1, 10, 5, 1, 2.0, 100.0, 0.1, "A"), (1, 11, 5, 1, 1.0, 50.0, 0.0, "N"), (None, 1, 1, 1, 1.0, 1.0, 0.0, "N")],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "x"), (1, 7, "y"), (2, 8, "z")], "o_orderkey long, o_custkey long, o_orderpriority string").withColumn(
        "o_orderdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "n", "s"), (None, "m", "s")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(
        f"{tmp_path}/customer.parquet")
    s = sales(Tables(spark, str(tmp_path)))
    assert sorted((r.invoice, r.customer, r.product, r.priority, r.amount) for r in s.collect()) == [
        (1, "n", 10, "x", 90.0), (1, "n", 10, "y", 90.0), (1, "n", 11, "x", 50.0), (1, "n", 11, "y", 50.0)]
    joins = [ln for ln in s._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in ln]
    assert "l_orderkey" in joins[0] and "c_custkey" in joins[1]  # the lines are in the outer join alone


def test_chunks_are_yielded_in_small_batches(spark):
    from unittest import mock

    import pyarrow as pa
    texts = [None, "", *["One sentence here. Another one there. " * 2000] * 60]
    d = spark.createDataFrame(list(enumerate(texts[:4])), "k long, text string")
    taken = {}
    with mock.patch.object(type(d), "mapInArrow", lambda self, fn, schema: taken.update(fn=fn)):
        X.sentence_chunks(d, "text", "k")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    out = list(taken["fn"](iter([batch])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 4 << 20
    want = [(i, c["chunk_index"], c["text"]) for i, t in enumerate(texts) for c in X.chunk_document(t)]
    assert [x for b in out for x in zip(*(b.column(c).to_pylist() for c in ("k", "chunk_index", "text")))] == want
    got = X.sentence_chunks(d, "text", "k").orderBy("k", "chunk_index").collect()
    assert [(r.k, r.chunk_index, r.text) for r in got] == [w for w in want if w[0] < 4]


def test_folds_read_written_features(spark):
    from unittest import mock

    from kestrel.operators import ml
    d = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    with mock.patch.object(ml, "written", wraps=ml.written) as w:
        assert ml.cross_validate(d, ["x"], "label").count() == 4
    assert w.call_count == 1


def test_hops_touch_only_the_edges_that_leave_the_frontier(spark):
    """Found nodes, parents and paths as a search by hand, on either way of joining; unless the frontier is large,
    nothing but the found nodes is written, and the frontier meets the edges before they are aggregated."""
    from pathlib import Path
    from unittest import mock

    from kestrel.operators import graph
    rows = [(f"n{i % 97}", f"n{i * 7 % 5000}") for i in range(20000)] + [("s", "n1"), ("s", "n2"), ("s", "n1"), ("n2", None), (None, "n3"), ("s", "s")]
    d = spark.createDataFrame(rows, "src string, dst string").repartition(3).withColumn("relation", F.lit("r"))
    edges = graph.undirected(d.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).cast("double").alias("weight")))

    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, last = [("s", 0, None, ["s"])], [("s", ["s"])]
    for h in (1, 2, 3):
        before, found = {w[0] for w in want} - {None}, {}
        for p, path in sorted((x for x in last if x[0] is not None), key=lambda x: x[0]):
            for b in near[p] - before:
                found.setdefault(b, (p, path))
        want += [(b, h, p, [*path, b]) for b, (p, path) in found.items()]
        last = [(b, [*path, b]) for b, (p, path) in found.items()]
    plans, real = [], type(edges).checkpoint

    def kept(self, eager=True):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString().splitlines())
        return real(self, eager)

    size = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    at = size()
    with mock.patch.object(type(edges), "checkpoint", kept):
        got = graph.bfs(edges, "s", 2)
    assert size() - at < 100_000  # the edges as rows are some 2 MB
    for plan in plans:
        semi = [i for i, x in enumerate(plan) if "LeftSemi" in x]
        below = [x for i in semi for x in plan[i + 1:i + 4]]
        assert len(semi) == 2 and any("Aggregate" in x for x in plan[:semi[0]]) and not any("Aggregate" in x for x in below)
    order = lambda r: (r[1], r[0] or "")
    assert sorted(map(tuple, got.collect()), key=order) == sorted((w for w in want if w[1] < 3), key=order)
    for most in (0, 1, 50):  # larger frontiers are joined by shuffle, from a table of edges
        with mock.patch.object(graph, "NEAR_ROWS", most):
            assert sorted(map(tuple, graph.bfs(edges, "s", 3).collect()), key=order) == sorted(want, key=order)
    assert sorted(r.id for r in graph.bfs(edges, "s", 3, ["n2", "n5", "none"]).collect()) == [w for w in ("n2", "n5") if w in {x[0] for x in want}]

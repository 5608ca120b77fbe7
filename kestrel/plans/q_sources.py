"""Registered queries for sources, sinks and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.plans.registry import query
from kestrel.session import Tables, scratch_path
from kestrel.sources import files


@query("a01_csv_scan", "SELECT * FROM customer")
def a01_csv_scan(spark, sf):
    """Land customer as CSV in the shared folder, scan it back with a schema
    and the NA-token rule."""
    t = Tables(spark, sf)
    path = scratch_path(spark, "csv")
    files.write_table(t.customer, path, "csv")
    return files.read_csv(spark, path, schema=t.customer.schema)


@query("a02_tsv_scan", "SELECT * FROM supplier")
def a02_tsv_scan(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "tsv")
    files.write_table(t.supplier, path, "tsv")
    return files.read_tsv(spark, path, schema=t.supplier.schema)


@query("a03_json_scan", "SELECT * FROM nation")
def a03_json_scan(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "json")
    files.write_table(t.nation, path, "json")
    return files.read_json(spark, path, schema=t.nation.schema, multi_line=False)


@query("a06_union_with_lineage",
       "SELECT *, 'orders_' || o_orderstatus AS _source_file FROM orders")
def a06_union_with_lineage(spark, sf):
    """Three 'files' (one per order status) unioned by name with a source tag."""
    o = Tables(spark, sf).orders
    parts = {f"orders_{s}": o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return files.union_sources(parts)


@query("a07_union_same_schema_else_largest", "SELECT * FROM nation")
def a07_union_same_schema_else_largest(spark, sf):
    t = Tables(spark, sf)
    return files.union_if_same_schema([t.region, t.nation])


@query("a08_seeded_sample_exact_n")
def a08_seeded_sample_exact_n(spark, sf):
    """Exactly 1000 orders chosen by a seeded hash (sampling is the feature)."""
    return files.sample_exact(Tables(spark, sf).orders, 1000, key=["o_orderkey"], seed=42)


@query("a09_stratified_sample", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey)) AS k FROM orders),
c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY o_orderpriority),
q AS (SELECT *, (round(total * 0.2)::BIGINT * n) // total AS whole, (round(total * 0.2)::BIGINT * n) % total AS remainder FROM c),
z AS (SELECT o_orderpriority, whole + (row_number() OVER (ORDER BY remainder DESC, o_orderpriority) <= round(total * 0.2)::BIGINT - sum(whole) OVER ())::INT AS quota
  FROM q)
SELECT r.* EXCLUDE (k), 'stratified' AS _sample_mode FROM r JOIN z USING (o_orderpriority) WHERE k <= quota""")
def a09_stratified_sample(spark, sf):
    return files.stratified_sample(Tables(spark, sf).orders, "o_orderpriority", 0.2, key=["o_orderkey"], seed=42)


A11_SQL = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price,
       avg(l_discount) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00'
GROUP BY l_returnflag, l_linestatus"""


@query("a11_sql_text_query", A11_SQL)
def a11_sql_text_query(spark, sf):
    """A10 register + A11 run SQL text through Spark SQL."""
    t = Tables(spark, sf)
    return files.run_sql(spark, A11_SQL, {"lineitem": t.lineitem})


@query("a12_parquet_sink_roundtrip", "SELECT * FROM part")
def a12_parquet_sink_roundtrip(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "parquet")
    files.write_table(t.part, path, "parquet")
    return spark.read.parquet(path)


@query("a13_log_scan", """SELECT * FROM events
WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
  AND contains(lower(event_type), 'cl')""")
def a13_log_scan(spark, sf):
    return files.log_scan(Tables(spark, sf).events, user=7, start="2024-01-05", end="2024-01-25",
                          action="cl", user_col="user_id", ts_col="ts", action_col="event_type")

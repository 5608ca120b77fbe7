"""Derived tables shared by the registered queries (and their SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import Tables


def sales(t: Tables) -> DataFrame:
    """The canonical transaction table of the test mapping:
    invoice, customer, segment, product, date, amount, quantity, plus the
    lineitem keys that make each row unique."""
    li, o, c = t.lineitem, t.orders, t.customer
    # orders meet their customers first: they are fewer and narrower than the lines, which then move once
    j = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_orderkey").alias("invoice"), F.col("c_name").alias("customer"),
        F.col("c_mktsegment").alias("segment"), F.col("l_partkey").alias("product"),
        F.col("o_orderdate").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.col("l_quantity").alias("quantity"), F.col("l_linenumber"), F.col("l_suppkey"),
        F.col("o_orderpriority").alias("priority"), F.col("l_returnflag").alias("returnflag"))


SALES_SQL = """sales AS (
  SELECT o.o_orderkey AS invoice, c.c_name AS customer, c.c_mktsegment AS segment,
         l.l_partkey AS product, o.o_orderdate AS date,
         l.l_extendedprice * (1 - l.l_discount) AS amount, l.l_quantity AS quantity,
         l.l_linenumber, l.l_suppkey, o.o_orderpriority AS priority, l.l_returnflag AS returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""

# unique order of sales rows (lineitem has no natural key; see FIXTURES.md)
SALES_ORDER = ["date", "invoice", "l_linenumber", "product", "l_suppkey"]
SALES_ORDER_SQL = "date, invoice, l_linenumber, product, l_suppkey"

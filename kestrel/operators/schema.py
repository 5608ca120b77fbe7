"""Schema intelligence: what a table's columns are and which business it is from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names that make out a domain, in order; of equal scores the first domain counts
DOMAINS = {
    "e-commerce": ("order", "product", "customer", "price", "quantity", "revenue", "discount", "category", "sku"),
    "finance": ("transaction", "amount", "balance", "account", "payment", "invoice", "credit", "debit"),
    "healthcare": ("patient", "diagnosis", "treatment", "hospital", "doctor", "insurance", "claim"),
    "marketing": ("campaign", "impression", "click", "conversion", "ctr", "cpc", "roi", "ad", "channel"),
    "hr": ("employee", "salary", "department", "hire", "performance", "leave", "attendance"),
    "sales": ("sale", "lead", "opportunity", "deal", "quota", "pipeline", "win", "close"),
}
# fixed values: a column belongs to the first category one of whose names it holds
CATEGORIES = {
    "identifier": ("id", "key", "index", "uuid"),
    "temporal": ("date", "time", "timestamp", "created", "updated"),
    "monetary": ("price", "amount", "cost", "revenue", "salary", "total"),
    "text": ("name", "title", "description", "text"),
    "contact": ("email", "phone", "address", "url"),
}
# fixed values: names of a metric, of no dimension, of the time column
METRIC_NAMES = ("price", "amount", "revenue", "sales", "cost", "profit", "total", "count", "qty", "quantity")
NO_DIMENSION = ("id", "date", "time", "timestamp")
TIME_NAMES = ("date", "time", "timestamp", "created", "order_date")


def holds(name: str, parts: Sequence[str]) -> bool:
    return any(p in name.lower() for p in parts)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def missing(field: T.StructField) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{field.name}`")
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value as text, n) of every present value: the rows are unpivoted and counted
    by one partial aggregate, whatever the number of columns; distinct counts and most
    frequent values follow from it without a second look at the table."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value"),
                               missing(f).alias("gone")) for f in fields])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where(~F.col("gone"))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one (nulls equal each other)."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def domain(names: Sequence[str]) -> tuple[str, float]:
    """The domain with most (name, column) hits and min(hits / 5, 1); none: general, 0.5."""
    hits = {d: sum(p in n.lower() for p in parts for n in names) for d, parts in DOMAINS.items()}
    best = max(hits, key=hits.get)
    return (best, min(hits[best] / 5, 1.0)) if hits[best] else ("general", 0.5)


def category(field: T.StructField) -> str:
    for c, parts in CATEGORIES.items():
        if holds(field.name, parts):
            return c
    return "numeric" if is_number(field.dataType) else "categorical"


def time_column(df: DataFrame) -> str | None:
    """The first column named like a time or of a time type."""
    return next((f.name for f in df.schema.fields if holds(f.name, TIME_NAMES) or is_time(f.dataType)), None)


def schema_columns(df: DataFrame, first: int = 10) -> DataFrame:
    """A row per column: position, type, missing and distinct values, category, mean /
    std / min / max of numeric ones, and whether it is one of the ``first`` key metrics
    (numeric, and named so or of over 10 values), of the ``first`` dimensions (text, or of at
    most 50 values; at least 2; not named an id or time) and the time column.

    An empty table gives its columns with zeros and null statistics; columns of a type
    without equality (maps) are not looked at."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    aggs = []
    for i, f in enumerate(fields):
        x = F.when(~missing(f), F.col(f"`{f.name}`").cast("double")) if is_number(f.dataType) else F.lit(None).cast("double")
        aggs += [F.count_if(missing(f)).alias(f"m{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    stats = df.agg(*aggs).select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
        F.lit(category(f)).alias("category"), F.col(f"m{i}").alias("missing"), F.col(f"a{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
        F.lit(is_number(f.dataType)).alias("_number"),
        F.lit(is_number(f.dataType) and holds(f.name, METRIC_NAMES)).alias("_named"),
        F.lit(isinstance(f.dataType, T.StringType)).alias("_text"),
        F.lit(not holds(f.name, NO_DIMENSION)).alias("_free")) for i, f in enumerate(fields)])).alias("c")).select("c.*")
    n = frequency(df, [f.name for f in fields]).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    out = stats.join(n, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    metric = F.col("_number") & (F.col("_named") | (F.col("distinct") > 10))
    dimension = F.col("_free") & (F.col("_text") | (F.col("distinct") <= 50)) & (F.col("distinct") >= 2)
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # rows = columns of the table
    out = out.withColumns({"is_metric": metric & (F.sum(metric.cast("int")).over(w) <= first),
                           "is_dimension": dimension & (F.sum(dimension.cast("int")).over(w) <= first)})
    t = time_column(df)
    return out.select("position", "column", "dtype", "category", "missing", "distinct", "mean", "std", "min", "max",
                      "is_metric", "is_dimension", (F.col("column") == F.lit(t)).alias("is_time") if t is not None
                      else F.lit(False).alias("is_time"))


def schema_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, rows that repeat another, completeness (null
    for an empty table), the domain its column names speak for with its confidence, the time
    column."""
    gone = reduce(lambda a, b: a + b, [missing(f).cast("long") for f in df.schema.fields])
    d, sure = domain(df.columns)
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(gone), F.lit(0)).alias("missing"))
    cells = F.col("rows") * len(df.columns)
    return base.select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing",
                       duplicate_rows(df).scalar().alias("duplicates"),
                       (1 - F.try_divide(F.col("missing"), cells)).alias("completeness"),
                       F.lit(d).alias("domain"), F.lit(sure).alias("domain_confidence"),
                       F.lit(time_column(df)).cast("string").alias("time_column"))

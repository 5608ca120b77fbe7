"""Table-level cleaning built on the scalar functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import scalars
from kestrel.plans.distributed import distinct_counts, exact_quantiles, stats_scalar


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _numerics(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def clean_table(df: DataFrame, lower: bool = False) -> DataFrame:
    """H1: trim every string column (optionally lower-case); nulls stay null
    (the reference turned them into the text 'nan')."""
    f = (lambda c: F.lower(F.trim(c))) if lower else F.trim
    return df.withColumns({c: f(F.col(c)) for c in _strings(df)})


def handle_missing(df: DataFrame, drop_empty_rows: bool = True, drop_empty_columns: bool = False,
                   fill: Mapping[str, object] | None = None) -> DataFrame:
    """H2: drop all-null rows, drop all-null columns (one aggregate decides),
    fill the rest from a per-column mapping."""
    out = df.na.drop(how="all") if drop_empty_rows else df
    if drop_empty_columns:
        row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
        out = out.drop(*[c for c in df.columns if row[c] == 0])
    if fill:
        out = out.fillna({k: v for k, v in fill.items() if k in out.columns})
    return out


def detect_dataset_currency(df: DataFrame, value_col: str | None = None, currency_col: str | None = None,
                            filename: str | None = None) -> DataFrame:
    """H7: one row (currency, source) by precedence: a currency column's most
    common code, then the most common currency detected in values, then
    column names, then the file name, then USD."""
    spark = df.sparkSession
    cands = []
    if currency_col:
        cands.append(df.where(F.col(currency_col).isNotNull()).groupBy(F.upper(currency_col).alias("currency"))
                     .count().select("currency", "count", F.lit("column").alias("source"), F.lit(1).alias("prio")))
    if value_col:
        det = scalars.detect_currency(F.col(value_col))
        cands.append(df.where(det.isNotNull()).groupBy(det.alias("currency")).count().select(
            "currency", "count", F.lit("values").alias("source"), F.lit(2).alias("prio")))
    by_names = scalars.currency_from_text(" ".join(df.columns))
    by_file = scalars.currency_from_text(filename) if filename else None
    fixed = [(by_names, "column_names", 3), (by_file, "filename", 4), ("USD", "default", 5)]
    rows = [(c, 1, s, p) for c, s, p in fixed if c]
    cands.append(spark.createDataFrame(rows, "currency string, count long, source string, prio int"))
    u = cands[0]
    for c in cands[1:]:
        u = u.unionByName(c)
    return u.orderBy("prio", F.desc("count"), "currency").limit(1).select("currency", "source")


def convert_column(df: DataFrame, amount: str, rates: DataFrame, target: str = "USD",
                   source_currency: str | None = None, currency_col: str | None = None) -> DataFrame:
    """H8/H9: add ``<amount>_converted`` and ``<amount>_currency``: amount in
    ``target`` through the USD pivot (amount * from_rate / to_rate).  The
    source currency is a constant or a per-row column; rates are the small
    fixed table (broadcast)."""
    r = F.broadcast(rates.select(F.col("currency").alias("_fx_cur"), F.col("usd_rate").alias("_fx_from")))
    to_rate = rates.where(F.col("currency") == target).select("usd_rate").scalar()
    src = F.col(currency_col) if currency_col else F.lit(source_currency or "USD")
    out = df.withColumn("_src_cur", src).join(r, F.col("_src_cur") == F.col("_fx_cur"), "left")
    conv = scalars.fx_convert(F.col(amount), F.col("_fx_from"), to_rate)
    return out.withColumn(f"{amount}_converted", conv).withColumn(f"{amount}_currency", F.lit(target)).drop(
        "_src_cur", "_fx_cur", "_fx_from")


def derive_value(df: DataFrame, price: str, quantity: str, out: str = "derived_value") -> DataFrame:
    """Price * quantity when both columns exist."""
    if price in df.columns and quantity in df.columns:
        return df.withColumn(out, F.col(price) * F.col(quantity))
    return df


def infer_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Convert columns whose lower-cased distinct values (at most 2) all
    fall in the true/false sets; others are left alone.  Values are counted
    once for all columns."""
    words = df.select(*[F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in columns])
    known = [F.col(c).isin(scalars.TRUE_VALUES + scalars.FALSE_VALUES) for c in columns]
    bad = words.agg(*[F.count_if(~k).alias(c) for c, k in zip(columns, known)]).first()
    few = {r["column"] for r in distinct_counts(words, columns).where(F.col("distinct") <= 2).collect()}  # one row per column
    conv = [c for c in columns if bad[c] == 0 and c in few]
    return df.withColumns({c: scalars.parse_bool(F.col(c)) for c in conv})


def winsorize(df: DataFrame, column: str, lower: float = 0.05, upper: float = 0.95, out: str | None = None) -> DataFrame:
    """Clip to the exact ``lower``/``upper`` percentiles (scalar subquery)."""
    q = exact_quantiles(df, column, [lower, upper], names=["lo", "hi"])
    s = stats_scalar(q)
    return df.withColumn(out or column, scalars.clip(F.col(column), s["lo"], s["hi"]))


def log1p_if_skewed(df: DataFrame, columns: Sequence[str], threshold: float = 2.0) -> DataFrame:
    """``log1p`` for non-negative columns whose bias-corrected |skew|
    exceeds ``threshold`` (one aggregate decides, values stay in Spark)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.skewness(x).alias(f"g1_{c}"), F.count(x).alias(f"n_{c}"), F.min(x).alias(f"min_{c}")]
    row = df.agg(*aggs).first()
    chosen = []
    for c in columns:
        n, g1, mn = row[f"n_{c}"], row[f"g1_{c}"], row[f"min_{c}"]
        if n is None or n < 3 or g1 is None or mn is None or mn < 0:
            continue
        skew = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
        if abs(skew) > threshold:
            chosen.append(c)
    return df.withColumns({c: F.log1p(F.col(c)) for c in chosen})


def with_row_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per-row statistics over the given numeric columns."""
    return df.withColumns(scalars.row_stats(columns))

"""Aggregation operators.

All aggregates are partial (map-side) aggregates first; exact quantiles go
through the range-scan primitive, and top-k per group through the salted
two-stage rank, so no group is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.plans.distributed import exact_quantiles, stats_scalar, top_k_per_group

_BASIC = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def _agg_expr(col: str, func: str, order: str | None = None) -> Column:
    c = F.col(col)
    f = func.lower()
    if f == "sum":
        return F.coalesce(F.sum(c), F.lit(0))  # S2: sum of nothing is 0
    if f in _BASIC:
        return _BASIC[f](c)
    if f == "nunique":
        return F.count_distinct(c)
    if f == "median":
        return F.median(c)
    if f == "std":
        return F.stddev_samp(c)
    if f == "var":
        return F.var_samp(c)
    if f in ("first", "last"):
        if order is None:
            raise ValueError("first/last need an order column")
        return (F.min_by if f == "first" else F.max_by)(c, F.col(order))
    if f == "size":
        return F.count(F.lit(1))
    raise ValueError(f"unknown aggregate {func}")


def group_aggregate(df: DataFrame, group_by: Sequence[str], aggs: Mapping[str, str | Sequence[str]],
                    order: str | None = None, drop_null_keys: bool = True) -> DataFrame:
    """``groupBy(*keys).agg`` with pandas names.

    Output columns are ``<col>_<func>``.  Null keys are dropped (S1) unless
    ``drop_null_keys=False``; an empty ``group_by`` returns one row.  Medians come from
    counts of distinct values on a range scan, so that no task holds the values of a hot
    group; a group without a value has none.
    """
    exprs, names, medians = [], [], {}
    for col, funcs in aggs.items():
        for f in ([funcs] if isinstance(funcs, str) else funcs):
            names.append(f"{col}_{f.lower()}")
            if f.lower() == "median":
                medians[names[-1]] = col
            else:
                exprs.append(_agg_expr(col, f, order).alias(names[-1]))
    base = df
    if drop_null_keys and group_by:
        base = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in group_by))
    out = base.groupBy(*group_by).agg(*(exprs or [F.count(F.lit(1)).alias("_rows")]))
    for name, col in medians.items():
        m = exact_quantiles(base, col, [0.5], by=group_by, names=[name])
        if group_by:
            m = m.withColumnsRenamed({k: "_m_" + k for k in group_by})
            same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_m_{k}`")) for k in group_by])
            out = out.join(m, same, "left").drop(*["_m_" + k for k in group_by])
        else:
            out = out.withColumn(name, m.scalar())
    return out.select(*[F.col(f"`{c}`") for c in (*group_by, *names)])


def column_stat(df: DataFrame, column: str, stat: str) -> DataFrame:
    """D3: one statistic of one column as a one-row table (column ``value``)."""
    return df.agg(_agg_expr(column, stat).cast("double").alias("value"))


def _is_numeric(t: str) -> bool:
    return t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")


def table_summary(df: DataFrame, numeric: Sequence[str] | None = None,
                  categorical: Sequence[str] | None = None, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(numeric summary, categorical summary).

    Numeric: one row per column with mean, median, std, min, max, sum, count,
    missing — a single wide aggregate plus exact medians over the unpivoted
    values.  Categorical: distinct count and the ``top`` most frequent values.
    """
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    numeric = list(numeric or [c for c, t in types.items() if _is_numeric(t)])
    categorical = list(categorical or [c for c, t in types.items() if t == "string"])
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("kv")).select("kv.*")
    stats = long.groupBy("column").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        F.max("v").alias("max"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"),
        F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("missing"))
    med = exact_quantiles(long, "v", [0.5], by=["column"], names=["median"])
    num = stats.join(med, "column", "left")
    cat = categorical_summary(df, categorical, top)
    return num, cat


def categorical_summary(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """D5 (strings): per column distinct count and top values with counts."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv")).select("kv.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    tops = top_k_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], top, out="rank")
    return tops.join(distinct, "column")


def entity_metrics(df: DataFrame, entity: str, value: str, n: int | None = 50) -> DataFrame:
    """Per entity total, count and mean, largest totals first (top ``n``)."""
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"))
    return g.orderBy(F.desc("total"), F.asc(entity)).limit(n) if n else g


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column (HyperLogLog++ when ``approximate``)."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in columns])


_FREQ = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "H": "hour"}


def time_bucket(ts: str | Column, freq: str) -> Column:
    """Period start for pandas-style frequencies; weeks start Monday."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(_FREQ.get(freq, freq), c.cast("timestamp"))


def time_bucket_sum(df: DataFrame, ts: str, value: str, freq: str = "M", out: str = "total") -> DataFrame:
    """Sum of ``value`` per period."""
    return (df.where(F.col(ts).isNotNull()).groupBy(time_bucket(ts, freq).alias("period"))
            .agg(F.sum(value).alias(out)))


def resample_filled(df: DataFrame, ts: str, value: str, freq: str | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Gap-filled resample; missing periods are 0.

    ``freq=None`` picks D (< 32 days span), W (< 180) or M per series, as the
    reference.  Rows are first summed per day (partial aggregate), the calendar
    is exploded from each series' (min, max) — bounded by span / frequency —
    and the period sums are left-joined onto it.
    """
    by = list(by)
    t = F.col(ts).cast("timestamp")
    daily = df.where(t.isNotNull()).groupBy(*by, F.date_trunc("day", t).alias("_day")).agg(F.sum(value).alias("_v"))
    span = daily.groupBy(*by).agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"))
    if freq is None:
        days = F.datediff(F.col("_hi"), F.col("_lo"))
        unit = F.when(days < 32, "day").when(days < 180, "week").otherwise("month")
    else:
        unit = F.lit(_FREQ.get(freq, freq))
    span = span.withColumn("_unit", unit)
    lo_t, hi_t = F.expr("date_trunc(_unit, _lo)"), F.expr("date_trunc(_unit, _hi)")
    n = (F.when(F.col("_unit") == "day", F.datediff(hi_t, lo_t))
         .when(F.col("_unit") == "week", F.datediff(hi_t, lo_t) / 7)
         .otherwise(F.months_between(hi_t, lo_t))).cast("int")
    cal = span.select(*by, "_unit", lo_t.alias("_lo_t"), F.explode(F.sequence(F.lit(0), n)).alias("_i"))
    months = F.when(F.col("_unit") == "month", F.col("_i")).otherwise(0)
    days = F.when(F.col("_unit") == "day", F.col("_i")).when(F.col("_unit") == "week", F.col("_i") * 7).otherwise(0)
    cal = cal.select(*by, (F.col("_lo_t") + F.make_interval(F.lit(0), months, F.lit(0), days)).alias("period"))
    if by:
        tagged = daily.join(span.select(*by, "_unit"), by)
    else:
        tagged = daily.withColumn("_unit", span.select("_unit").scalar())
    sums = tagged.groupBy(*by, F.expr("date_trunc(_unit, _day)").alias("period")).agg(F.sum("_v").alias("_v"))
    return cal.join(sums, [*by, "period"], "left").select(*by, "period", F.coalesce("_v", F.lit(0.0)).alias("value"))


def monthly_revenue_customers(df: DataFrame, ts: str, value: str, customer: str) -> DataFrame:
    """Per month revenue and distinct active customers."""
    return (df.where(F.col(ts).isNotNull()).groupBy(time_bucket(ts, "M").alias("month"))
            .agg(F.sum(value).alias("revenue"), F.count_distinct(customer).alias("active_customers")))


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "sum",
                column_values: Sequence | None = None) -> DataFrame:
    """``groupBy(index).pivot(columns, values).agg``; headers flattened.

    Pass ``column_values`` to avoid the extra distinct-values job.
    """
    g = df.groupBy(*index).pivot(columns, list(column_values) if column_values is not None else None)
    return g.agg(_agg_expr(values, aggfunc))


def crosstab(df: DataFrame, row: str, col: str, value: str | None = None, top: int | None = None,
             col_values: Sequence | None = None) -> DataFrame:
    """Counts (or sums) of row x col, optionally limited to the top
    ``top`` categories of each dimension first (C3).  Long form:
    (row, col, value)."""
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if top:
        from kestrel.operators.frame import topk_membership
        base = topk_membership(topk_membership(base, row, top), col, top)
    metric = F.count(F.lit(1)) if value is None else F.sum(value)
    return base.groupBy(row, col).agg(metric.alias("value"))


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """``unpivot``; values are cast to a common type by Spark."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and share of rows per value (nulls excluded), most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    counts = counts.withColumn("share", F.col("count") / total)
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(top) if top else counts


def mode(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, smallest on ties, per group (salted top-1)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    best = top_k_per_group(counts, list(by) or [], [F.desc("_n"), F.asc(column)], 1) if by else \
        counts.orderBy(F.desc("_n"), F.asc(column)).limit(1)
    return best.select(*by, F.col(column).alias("mode"), F.col("_n").alias("mode_count"))


PERCENTILES = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


def _moments(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    x = F.col(column).cast("double")
    g = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n = F.col("n").cast("double")
    # Spark's moments are population; pandas' are bias-corrected
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return g.withColumn("skew", skew).withColumn("kurtosis", kurt).drop("_g1", "_g2")


def percentiles(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """p10..p99, bias-corrected skew and kurtosis, and a shape label
    (|skew| < 0.5 normal, > 0 right-skewed, else left-skewed)."""
    q = exact_quantiles(df, column, PERCENTILES, by=by)
    m = _moments(df, column, by)
    out = m.join(q, list(by)) if by else _one_row_join(m, q)
    return out.withColumn("shape", F.when(F.abs("skew") < 0.5, "normal")
                          .when(F.col("skew") > 0, "right-skewed").otherwise("left-skewed"))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row tables on a constant key (both sides have one row)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def five_numbers(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, q1, median, q3, max."""
    return exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], by=by,
                           names=["min", "q1", "median", "q3", "max"])


def variance_pack(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Mean, std, var, cv %, quartiles, IQR, range and IQR-outliers.

    Two steps: the statistics, then a conditional count against the fences
    read from a scalar subquery (no join, no driver round trip).
    """
    x = F.col(column).cast("double")
    base = df.where(x.isNotNull())
    q = exact_quantiles(base, column, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    m = base.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("var"),
                 F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    stats = _one_row_join(m, q).withColumns({
        "cv_pct": F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean")) * 100),
        "iqr": F.col("q3") - F.col("q1"), "range": F.col("max") - F.col("min")})
    s = stats_scalar(stats.select("q1", "q3", "iqr"))
    lo, hi = s["q1"] - k * s["iqr"], s["q3"] + k * s["iqr"]
    out = base.agg(F.count_if((x < lo) | (x > hi)).alias("outliers"))
    return _one_row_join(stats, out).withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n"))


def histogram(df: DataFrame, column: str, bins: int | None = 10, dense: bool = True) -> DataFrame:
    """Equal-width bins like ``np.histogram``: ``[a, b)`` except the last
    bin, which is closed (S14).  ``bins=None`` uses min(20, distinct values).
    Empty bins are produced from ``sequence`` when ``dense``."""
    x = F.col(column).cast("double")
    base = df.where(x.isNotNull() & ~F.isnan(x))
    if bins is None:
        st = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                      F.least(F.lit(20), F.count_distinct(x)).alias("nb"))
    else:
        st = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.lit(bins).alias("nb"))
    s = stats_scalar(st)
    lo, hi, nb = s["lo"], s["hi"], s["nb"]
    width = (hi - lo) / nb
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), nb - 1)).cast("int")
    counts = base.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if dense:
        allb = st.select(F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)).alias("bin"))
        counts = allb.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    w = F.when(hi == lo, F.lit(0.0)).otherwise(width)
    return counts.select("bin", (lo + F.col("bin") * w).alias("bin_start"),
                         F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * w).alias("bin_end"), "count")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r for every column pair (pairwise complete), one aggregate.

    Long form (col_a, col_b, r) with a < b in the given order.
    """
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.5,
                      strong: float = 0.7, moderate: float = 0.4) -> DataFrame:
    """Pairs with |r| >= threshold and a strength class."""
    m = correlation_matrix(df, columns).where(F.abs("r") >= threshold)
    return m.withColumn("strength", F.when(F.abs("r") >= strong, "strong")
                        .when(F.abs("r") >= moderate, "moderate").otherwise("weak")).withColumn(
        "direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))


def concentration(df: DataFrame, entity: str, value: str, hhi_top: int | None = None) -> DataFrame:
    """CR4, CR8, HHI over all shares (in %; over the ``hhi_top`` largest if
    given), leader and market structure (< 1500 competitive, < 2500 moderate, else
    concentrated)."""
    totals = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.sum(value).alias("_t"))
    grand = totals.agg(F.sum("_t")).scalar()
    shares = totals.withColumn("_share", F.col("_t") / grand * 100)
    order = [F.desc("_t"), F.asc(entity)]
    counted = shares if hhi_top is None else shares.orderBy(*order).limit(hhi_top)
    hhi = counted.agg(F.sum(F.col("_share") * F.col("_share"))).scalar()
    ranked = shares.orderBy(*order).limit(8).withColumn("_rk", F.row_number().over(Window.orderBy(*order)))  # <= 8 rows
    out = ranked.agg(
        F.sum(F.when(F.col("_rk") <= 4, F.col("_share")).otherwise(0.0)).alias("cr4"),
        F.sum(F.when(F.col("_rk") <= 8, F.col("_share")).otherwise(0.0)).alias("cr8"),
        hhi.alias("hhi"),
        F.max_by(F.col(entity).cast("string"), -F.col("_rk")).alias("leader"),
        F.max_by(F.col("_share"), -F.col("_rk")).alias("leader_share"))
    return out.withColumn("structure", F.when(F.col("hhi") < 1500, "competitive")
                          .when(F.col("hhi") < 2500, "moderate").otherwise("concentrated"))


def category_concentration(df: DataFrame, column: str) -> DataFrame:
    """Share of rows held by the top 1, 3 and 5 values and a class
    (top-1 > 50 % dominated, top-3 > 80 % concentrated, else distributed)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    top = counts.orderBy(F.desc("_n"), F.asc(column)).limit(5).withColumn(
        "_rk", F.row_number().over(Window.orderBy(F.desc("_n"), F.asc(column))))  # <= 5 rows
    out = top.agg(*[(F.sum(F.when(F.col("_rk") <= k, F.col("_n")).otherwise(0)) * 100.0 / total).alias(f"top{k}_pct")
                    for k in (1, 3, 5)])
    return out.withColumn("concentration", F.when(F.col("top1_pct") > 50, "dominated")
                          .when(F.col("top3_pct") > 80, "concentrated").otherwise("distributed"))


def balance_entropy(df: DataFrame, column: str) -> DataFrame:
    """Balance of category counts: max/min ratio and class (< 1.5
    balanced, < 3 moderate, else imbalanced), variance and quartiles of the
    counts, Shannon entropy (log2) and its ratio to log2(k).  The quartiles come from a range
    scan, so the categories may be many."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    quarts = stats_scalar(exact_quantiles(counts, "n", [0.25, 0.5, 0.75], names=["q1", "q2", "q3"]))
    total = counts.agg(F.sum("n")).scalar()
    p = F.col("n") / total
    st = counts.agg(F.max("n").alias("max_count"), F.min("n").alias("min_count"),
                    F.count(F.lit(1)).alias("k"), F.var_samp("n").alias("count_variance"),
                    (-F.sum(p * F.log2(p))).alias("entropy"))
    st = st.withColumns({"count_q1": quarts["q1"], "count_median": quarts["q2"], "count_q3": quarts["q3"]})
    st = st.withColumn("ratio", F.col("max_count") / F.col("min_count")).withColumn(
        "balance", F.when(F.col("ratio") < 1.5, "balanced").when(F.col("ratio") < 3, "moderate").otherwise("imbalanced"))
    return st.withColumn("entropy_ratio", F.when(F.col("k") > 1, F.col("entropy") / F.log2(F.col("k").cast("double"))))


def category_extremes(df: DataFrame, column: str, ends: int = 2, sigmas: float = 2.0) -> DataFrame:
    """(kind, category, n, pct): the ``ends`` most and least frequent categories (``top``,
    ``bottom``; ties by name; none with fewer than 2 x ``ends`` categories) and every category
    whose count lies more than ``sigmas`` sample deviations above (``high``) or below (``low``)
    the mean count.  Below is asked only where the mean exceeds that distance, as no count is
    negative.  Null is no category."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("n"))
    s = stats_scalar(counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"),
                                F.stddev_samp("n").alias("sd")))
    rows = counts.select("category", "n", (F.col("n") * 100.0 / s["total"]).alias("pct"))
    enough = s["k"] >= 2 * ends
    top = rows.orderBy(F.desc("n"), F.asc("category")).limit(ends).where(enough)
    bottom = rows.orderBy(F.asc("n"), F.desc("category")).limit(ends).where(enough)
    far = sigmas * s["sd"]
    parts = [("top", top), ("bottom", bottom), ("high", rows.where(F.col("n") > s["mean"] + far)),
             ("low", rows.where((s["mean"] > far) & (F.col("n") < s["mean"] - far)))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "category", "n", "pct") for k, d in parts])


def group_range(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min, max, mean per group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def comparison_matrix(df: DataFrame, categoricals: Sequence[str], numerics: Sequence[str]) -> DataFrame:
    """For every categorical x numeric pair: sum, mean, count per value.

    Both sides are unpivoted into (dimension, value, metric, x) rows and one
    group-by computes every pair.
    """
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("category"))
                               for c in categoricals])).alias("d")
    mets = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"))
                               for m in numerics])).alias("m")
    long = df.select(dims, *numerics).select("d.*", *numerics).select("dimension", "category", mets).select(
        "dimension", "category", "m.*")
    return long.where(F.col("category").isNotNull()).groupBy("dimension", "category", "metric").agg(
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("sum"), F.avg("x").alias("mean"), F.count("x").alias("count"))


def fx_rates_table(spark) -> DataFrame:
    """The fixed FX table (currency, usd_rate) — ten rows, safe to broadcast."""
    return spark.createDataFrame(sorted(scalars.FX_RATES_TO_USD.items()), "currency string, usd_rate double")


def currency_breakdown(df: DataFrame, amount: str, currency: str, rates: DataFrame) -> DataFrame:
    """Per currency total, USD equivalent, share of USD total and a
    primary-currency flag (largest USD total)."""
    g = df.groupBy(currency).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("count"))
    g = g.join(F.broadcast(rates.withColumnRenamed("currency", currency)), currency, "left")
    g = g.withColumn("usd_total", F.col("total") * F.coalesce(F.col("usd_rate"), F.lit(1.0)))
    grand = g.agg(F.sum("usd_total")).scalar()
    best = g.agg(F.max_by(currency, F.struct("usd_total", F.col(currency)))).scalar()
    return g.select(currency, "total", "count", "usd_total", (F.col("usd_total") / grand * 100).alias("share_pct"),
                    (F.col(currency) == best).alias("is_primary"))


def grouping_sets(df: DataFrame, dims: Sequence[str], value: str, kind: str = "cube") -> DataFrame:
    """CUBE / ROLLUP with a grouping id."""
    g = df.cube(*dims) if kind == "cube" else df.rollup(*dims)
    return g.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))


def source_summary(df: DataFrame, source: str, value: str) -> DataFrame:
    """Per source file rows and total."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def storage_used(df: DataFrame, user: str, size: str) -> DataFrame:
    """``coalesce(sum(size), 0)`` per user."""
    return df.groupBy(user).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes_used"))


"""Dashboards and reports as tidy tables.

Every report is a DataFrame of (section, item, measure, value): a page shows a section, a
chart an item's measures.  ``rank`` measures carry the order of a list.  Nulls of a measure
stay out of it; an empty table gives the sections whose rows do not depend on its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators import aggregate as agg
from kestrel.operators import schema as sch
from kestrel.operators import windows as win
from kestrel.plans.distributed import exact_quantiles, global_rank, stats_scalar, top_k_per_group, written
from kestrel.session import checkpoint_dir


def _tidy(df: DataFrame, section: str, item: Column | str, measures: Sequence[str]) -> DataFrame:
    """Rows of ``df`` to (section, item, measure, value), a row per measure that is not null."""
    item = F.col(item) if isinstance(item, str) else item
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(cells).alias("c")).select(
        "section", "item", "c.*").where(F.col("value").isNotNull())


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _per_column(df: DataFrame, section: str, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate over the table: ``measures`` maps a measure to a function of (name, column)."""
    aggs = [fn(c, F.col(f"`{c}`").cast("double")).cast("double").alias(f"{i}:{m}")
            for i, c in enumerate(columns) for m, fn in measures.items()]
    rows = [F.struct(F.lit(section).alias("section"), F.lit(c).alias("item"), F.lit(m).alias("measure"),
                     F.col(f"`{i}:{m}`").alias("value")) for i, c in enumerate(columns) for m in measures]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("value").isNotNull())


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if sch.is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# ---------------------------------------------------------------- K14


def monthly_timeline(df: DataFrame, date: str, value: str, customer: str) -> DataFrame:
    """Revenue, orders (rows), average order and distinct customers per calendar month;
    rows without a date are left out. Customers count in two steps, month and customer first."""
    pairs = df.where(F.col(date).isNotNull()).groupBy(F.date_trunc("month", F.col(date)).alias("month"), customer).agg(
        F.sum(value).alias("r"), F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("month").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("revenue"), F.sum("n").alias("orders"),
                                      F.count(customer).alias("customers")).withColumn(
        "avg_order", F.try_divide("revenue", "orders"))


def period_growth(timeline: DataFrame) -> DataFrame:
    """Change in percent of the last month against the month before it among those present,
    per measure; null with one month, or from zero."""
    last = timeline.orderBy(F.desc("month")).limit(2)
    names = ["revenue", "orders", "customers", "avg_order"]
    now = stats_scalar(last.agg(*[F.max_by(c, "month").cast("double").alias(c) for c in names], F.count(F.lit(1)).alias("n")))
    before = last.agg(*[F.min_by(c, "month").cast("double").alias(c) for c in names])
    return before.select(*[F.when((now["n"] == 2) & (F.col(c) != 0), F.try_divide(now[c] - F.col(c), F.abs(F.col(c))) * 100).alias(c)
                           for c in names])


def dashboard_stats(df: DataFrame, date: str, value: str, customer: str, product: str) -> DataFrame:
    """Totals; ABC grades of all products and customers with the sums per grade;
    value tiers of all customers with the sums per tier; the monthly timeline and the growth of its last
    month; the findings (share of the top three customers, A customers' share of all, customers and
    revenue at risk).

    Entities are ranked on a range scan, never in one task; only grades, tiers, months and
    the one-row totals are small. Rows without a customer or product count in the totals."""
    checkpoint_dir(df.sparkSession)
    base = written(df.select(date, value, customer, product), "dashboard")  # read for each of the tables below
    months = monthly_timeline(base, date, value, customer).checkpoint()  # a row per month
    products = win.abc_grade(base, product, value)
    customers = win.abc_grade(base, customer, value)
    tiers = win.customer_tiers(base, customer, value)
    total = base.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    total = total.select(
        "revenue", "orders", F.try_divide("revenue", "orders").alias("avg_order"),
        customers.agg(F.count(F.lit(1))).scalar().alias("customers"),
        products.agg(F.count(F.lit(1))).scalar().alias("products"))
    parts = [_tidy(total, "totals", F.lit("all"), total.columns)]
    code = F.element_at(F.create_map(F.lit("A"), F.lit(1), F.lit("B"), F.lit(2), F.lit("C"), F.lit(3)), F.col("grade"))
    for name, entity, graded in (("product", product, products), ("customer", customer, customers)):
        parts.append(_tidy(graded.withColumn("grade_no", code), f"abc_{name}", entity,
                           ["total", "share_pct", "cumulative_pct", "rank", "grade_no"]))
        parts.append(_tidy(graded.groupBy("grade").agg(F.count(F.lit(1)).alias("entities"), F.sum("total").alias("revenue")),
                           f"abc_{name}_summary", "grade", ["entities", "revenue"]))
    n = tiers.agg(F.count(F.lit(1))).scalar()
    in_tier = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("customers"), F.sum("total").alias("revenue")).withColumn(
        "customer_pct", F.col("customers") * 100.0 / n)
    parts += [_tidy(tiers, "tier_customer", F.concat_ws("/", "tier", customer), ["total", "count", "avg_order", "rank"]),
              _tidy(in_tier, "tier_summary", "tier", ["customers", "revenue", "customer_pct"]),
              _tidy(months, "timeline", F.date_format("month", "yyyy-MM"), ["revenue", "orders", "customers", "avg_order"]),
              _tidy(period_growth(months), "growth_pct", F.lit("last_month"), ["revenue", "orders", "customers", "avg_order"])]
    found = customers.agg(F.sum(F.when(F.col("rank") <= 3, F.col("share_pct"))).alias("top3_customers_pct"),
                          F.count_if(F.col("grade") == "A").alias("a_customers"),
                          F.try_divide(F.count_if(F.col("grade") == "A") * 100.0, F.count(F.lit(1))).alias("a_customers_pct"))
    risk = in_tier.where("tier = 'At Risk'").select(F.col("customers").alias("at_risk_customers"),
                                                    F.col("revenue").alias("at_risk_revenue"))
    parts += [_tidy(found, "findings", F.lit("customers"), found.columns), _tidy(risk, "findings", F.lit("tiers"), risk.columns)]
    return _union(parts)


# ---------------------------------------------------------------- K18


def metrics_report(df: DataFrame, order: Sequence[str], bins: int = 10) -> DataFrame:
    """K18 metrics: mean and std of every numeric column, change of its mean from the first
    half of the rows (in ``order``, which is unique) to the second, histogram of the first
    numeric column.  A half without a value, or a first mean of zero, gives no change (0 in the latter case)."""
    nums = numeric_columns(df)
    keep = list(dict.fromkeys([*nums, *order]))
    df = written(df.select(*keep), "metrics")  # read for each of the tables below
    parts = [_per_column(df, "overview", nums, {"mean": lambda n, x: F.avg(x), "std": lambda n, x: F.stddev_samp(x)})]
    r = global_rank(df, list(order), out="_rank")
    early = F.col("_rank") <= F.floor(r.agg(F.count(F.lit(1))).scalar() / 2)

    def change(_, x):
        a, b = F.avg(F.when(early, x)), F.avg(F.when(~early, x))
        return F.when(a == 0, F.when(b.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(b - a, a) * 100)

    parts.append(_per_column(r, "half_change_pct", nums, {"change": change}))
    if nums:
        h = agg.histogram(df, nums[0], bins)
        parts.append(_tidy(h, f"histogram_{nums[0]}", "bin", ["bin_start", "bin_end", "count"]))
    return _union(parts)


def breakdown_report(df: DataFrame, top: int = 8, top_groups: int = 10) -> DataFrame:
    """K18 breakdown: distinct values and rows present of every text column, its ``top`` most
    frequent values (ties by value), and the ``top_groups`` largest means of the first numeric
    column by the first text column (null is no group)."""
    texts, nums = text_columns(df), numeric_columns(df)
    if not texts:
        raise ValueError("a breakdown needs a text column")
    counts = sch.frequency(df, texts)
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("present"))
    best = top_k_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], top, out="rank")
    parts = [_tidy(per, "columns", "column", ["distinct", "present"]),
             _tidy(best, "values", F.concat_ws("=", "column", "value"), ["n", "rank"])]
    if nums:
        c, x = texts[0], nums[0]
        g = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("g")).agg(F.avg(F.col(f"`{x}`")).alias("mean"))
        g = g.where(F.col("mean").isNotNull()).orderBy(F.desc("mean"), "g").limit(top_groups)
        parts.append(_tidy(g, f"mean_{x}_by_{c}", "g", ["mean"]))
    return _union(parts)


def summary_report(df: DataFrame) -> DataFrame:
    """K18 summary: rows, columns by kind, missing cells and repeated rows with the quality
    score max(0, 100 - 2 x missing % - 50 x repeated share), mean / min / max of every numeric
    column and the missing values of every column."""
    fields = df.schema.fields
    kinds = {"columns": len(fields), "numeric_columns": len(numeric_columns(df)), "text_columns": len(text_columns(df)),
             "time_columns": sum(sch.is_time(f.dataType) for f in fields)}
    s = sch.schema_summary(df).select("rows", "missing", "duplicates", "columns")
    share = F.try_divide("missing", F.col("rows") * F.col("columns")) * 100
    s = s.select("rows", "missing", "duplicates", share.alias("missing_pct"), (100 - share).alias("completeness_pct"),
                 F.greatest(F.lit(0.0), 100 - share * 2 - F.try_divide("duplicates", "rows") * 50).alias("quality_score"),
                 *[F.lit(v).alias(k) for k, v in kinds.items()])
    gone = {f.name: sch.missing(f) for f in fields}
    nulls = df.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(gone.values())]).select(F.explode(F.array(*[
        F.struct(F.lit("missing").alias("section"), F.lit(n).alias("item"), F.lit("missing").alias("measure"),
                 F.col(f"_{i}").cast("double").alias("value")) for i, n in enumerate(gone)])).alias("r")).select("r.*")
    present = {f.name: ~sch.missing(f) for f in fields}
    stats = _per_column(df, "statistics", numeric_columns(df), {
        "mean": lambda n, x: F.avg(F.when(present[n], x)), "min": lambda n, x: F.min(F.when(present[n], x)),
        "max": lambda n, x: F.max(F.when(present[n], x))}) if numeric_columns(df) else None
    return _union([p for p in (_tidy(s, "overview", F.lit("table"), s.columns), stats, nulls) if p is not None])


def anomaly_report(df: DataFrame, z: float = 3.0) -> DataFrame:
    """K18 anomalies: per numeric column the values over ``z`` standard deviations from the
    mean (a constant column has none) and their sum; five numbers and 1.5 IQR bounds of the
    first numeric column with the values outside them."""
    nums = numeric_columns(df)
    if not nums:
        raise ValueError("anomalies need a numeric column")
    st = stats_scalar(df.agg(*[a for i, c in enumerate(nums) for x in [F.col(f"`{c}`").cast("double")]
                               for a in (F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"))]))
    at = {c: i for i, c in enumerate(nums)}
    per = _per_column(df, "z_score", nums, {"anomalies": lambda n, x: F.count_if(
        (st[f"s{at[n]}"] > 0) & (F.abs(F.try_divide(x - st[f"a{at[n]}"], st[f"s{at[n]}"])) > z))})
    total = per.agg(F.sum("value").alias("anomalies"))
    first = nums[0]
    q = exact_quantiles(df, first, [0.0, 0.25, 0.5, 0.75, 1.0], names=["min", "q1", "median", "q3", "max"])
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1")}).withColumns(
        {"lower": F.col("q1") - 1.5 * F.col("iqr"), "upper": F.col("q3") + 1.5 * F.col("iqr")})
    bounds = stats_scalar(q.select("lower", "upper"))
    x = F.col(f"`{first}`").cast("double")
    outside = df.agg(F.count_if((x < bounds["lower"]) | (x > bounds["upper"])).alias("outside"))
    return _union([per, _tidy(total, "z_score", F.lit("all"), ["anomalies"]),
                   _tidy(q, "box", F.lit(first), ["min", "q1", "median", "q3", "max", "iqr", "lower", "upper"]),
                   _tidy(outside, "box", F.lit(first), ["outside"])])


# ---------------------------------------------------------------- K16, K17, K19


def _totals(df: DataFrame, entity: str, value: str) -> DataFrame:
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("total"), F.count(F.lit(1)).alias("orders"))


def _ranked_list(totals: DataFrame, k: int, bottom: bool = False) -> DataFrame:
    order = [F.asc("total") if bottom else F.desc("total"), F.asc("entity")]
    return totals.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def enterprise_report(df: DataFrame, value: str, customer: str, product: str, top: int = 5) -> DataFrame:
    """Revenue, orders (rows), average order, distinct customers and products; the
    ``top`` customers and products with their rows and share of the revenue; the share of the top customers together.  A revenue
    that is not positive gives shares of 0."""
    by_customer, by_product = _totals(df, customer, value), _totals(df, product, value)
    t = df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("orders")).select(
        "revenue", "orders", F.try_divide("revenue", "orders").alias("avg_order"),
        by_customer.agg(F.count(F.lit(1))).scalar().alias("customers"),
        by_product.agg(F.count(F.lit(1))).scalar().alias("products"))
    revenue = df.agg(F.coalesce(F.sum(value), F.lit(0.0))).scalar()
    share = F.when(revenue > 0, F.try_divide(F.col("total"), revenue) * 100).otherwise(0.0)
    c, p = (_ranked_list(x, top).withColumn("share_pct", share) for x in (by_customer, by_product))
    risk = c.agg(F.sum("share_pct").alias("top_customers_pct"))
    return _union([_tidy(t, "totals", F.lit("all"), t.columns),
                   _tidy(c, "customers", "entity", ["total", "orders", "share_pct", "rank"]),
                   _tidy(p, "products", "entity", ["total", "orders", "share_pct", "rank"]),
                   _tidy(risk, "concentration", F.lit("customers"), ["top_customers_pct"])])


def period_summary(df: DataFrame, date: str, value: str, customer: str, product: str, days: int, top: int,
                   currency: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """The last ``days`` (7: weekly, 30: monthly) up to the latest date: revenue, rows,
    average, distinct customers and products, growth against the ``days`` before (0 where
    those hold no revenue), the sums of weeks that end on Sunday, the ``top`` customers and products, and with a
    ``currency`` column its totals in itself and in USD by ``rates`` (currency, usd_rate; an
    unknown one counts 1).  Rows without a date are left out."""
    ref = df.agg(F.max(date)).scalar()
    start = ref - F.make_interval(days=F.lit(days))
    cur = df.where(F.col(date) >= start)
    prev = df.where((F.col(date) < start) & (F.col(date) >= ref - F.make_interval(days=F.lit(2 * days))))
    before = prev.agg(F.coalesce(F.sum(value), F.lit(0.0))).scalar()
    by_customer, by_product = _totals(cur, customer, value), _totals(cur, product, value)
    t = cur.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("orders"),
                F.avg(value).alias("avg_order"))
    t = t.select("revenue", "orders", "avg_order", by_customer.agg(F.count(F.lit(1))).scalar().alias("customers"),
                 by_product.agg(F.count(F.lit(1))).scalar().alias("products"),
                 F.when(before > 0, F.try_divide(F.col("revenue") - before, before) * 100).otherwise(0.0).alias("growth_pct"))
    sunday = F.date_add(F.date_trunc("week", F.col(date)).cast("date"), 6)
    weeks = cur.groupBy(sunday.alias("week")).agg(F.sum(value).alias("revenue"))
    parts = [_tidy(t, "totals", F.lit("period"), t.columns),
             _tidy(weeks, "weeks", F.date_format("week", "yyyy-MM-dd"), ["revenue"]),
             _tidy(_ranked_list(by_customer, top), "customers", "entity", ["total", "rank"]),
             _tidy(_ranked_list(by_product, top), "products", "entity", ["total", "rank"])]
    if currency is not None:
        g = agg.currency_breakdown(cur.where(F.col(currency).isNotNull()), value, currency, rates)
        parts += [_tidy(g, "currencies", currency, ["total", "usd_total", "share_pct"]),
                  _tidy(g.agg(F.sum("usd_total").alias("usd_total")), "currencies", F.lit("all"), ["usd_total"])]
    return _union(parts)


def summary_texts(df: DataFrame, date: str, value: str, customer: str, product: str, symbol: str = "",
                  customers: int = 20, products: tuple[int, int] = (15, 10)) -> DataFrame:
    """Text rows (chunk, line, text) of a dataset: its summary, the top and bottom
    ``customers``, the top and bottom ``products``, and the revenue of every month, each line ready for an
    index of texts.  Null amounts count 0; rows without a date stay out of the months."""
    def money(c):
        return F.concat(F.lit(symbol), F.format_number(c, 2))

    x = F.coalesce(F.col(value), F.lit(0.0))
    df = df.withColumn(value, x)
    by_customer, by_product = _totals(df, customer, value), _totals(df, product, value)
    t = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
               F.coalesce(F.avg(value), F.lit(0.0)).alias("avg")).select(
        "*", by_customer.agg(F.count(F.lit(1))).scalar().alias("c"), by_product.agg(F.count(F.lit(1))).scalar().alias("p"))
    lines = F.array(F.concat(F.lit("Total Records: "), F.col("n").cast("string")),
                    F.concat(F.lit("Total Revenue: "), money("total")),
                    F.concat(F.lit("Average Order Value: "), money("avg")),
                    F.concat(F.lit("Unique Customers: "), F.col("c").cast("string")),
                    F.concat(F.lit("Unique Products: "), F.col("p").cast("string")))
    parts = [t.select(F.lit("summary").alias("chunk"), F.posexplode(lines).alias("line", "text")).withColumn(
        "line", F.col("line") + 1)]
    lists = (("top_customers", by_customer, customers, False, "orders"), ("bottom_customers", by_customer, customers, True, "orders"),
             ("top_products", by_product, products[0], False, "sales"), ("bottom_products", by_product, products[1], True, "sales"))
    for name, totals, k, bottom, noun in lists:
        r = _ranked_list(totals, k, bottom)
        parts.append(r.select(F.lit(name).alias("chunk"), F.col("rank").alias("line"), F.concat(
            F.col("rank").cast("string"), F.lit(". "), F.col("entity"), F.lit(": "), money("total"), F.lit(" ("),
            F.col("orders").cast("string"), F.lit(f" {noun})")).alias("text")))
    m = df.where(F.col(date).isNotNull()).groupBy(F.date_trunc("month", F.col(date)).alias("month")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("orders"))
    parts.append(m.select(F.lit("months").alias("chunk"), F.row_number().over(Window.orderBy("month")).alias("line"),  # months
                          F.concat(F.date_format("month", "yyyy-MM"), F.lit(": "), money("total"), F.lit(" ("),
                                   F.col("orders").cast("string"), F.lit(" orders)")).alias("text")))
    return _union(parts)

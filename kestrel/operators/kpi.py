"""Business analytics: cohorts, root cause, alerts, insights, KPI cards
(SURVEY §2.K).  Results are tidy DataFrames (one row per finding / KPI)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators import windows as win
from kestrel.plans.distributed import stats_scalar

_TRUNC = {"M": "month", "W": "week", "Q": "quarter"}


def cohort_retention(df: DataFrame, date: str, user: str, value: str | None = None, period: str = "M") -> DataFrame:
    """K1: cohort = period of a user's first activity; for every (cohort,
    offset) the active users, retention % of the cohort's offset-0 size and,
    with ``value``, total and average value.  First activity is a group-by +
    join (partial aggregation), not a window over users."""
    unit = _TRUNC[period]
    base = df.where(F.col(user).isNotNull() & F.col(date).isNotNull())
    first = base.groupBy(user).agg(F.min(date).alias("_first"))
    j = base.join(first, user)
    cohort = F.date_trunc(unit, F.col("_first"))
    act = F.date_trunc(unit, F.col(date))
    if period == "M":
        off = F.months_between(act, cohort).cast("int")
    elif period == "Q":
        off = (F.months_between(act, cohort) / 3).cast("int")
    else:
        off = (F.datediff(act, cohort) / 7).cast("int")
    j = j.select(user, cohort.alias("cohort"), off.alias("period_offset"), *( [F.col(value)] if value else []))
    aggs = [F.count_distinct(user).alias("active_users")]
    if value:
        aggs += [F.sum(value).alias("total_value"), F.avg(value).alias("avg_value")]
    g = j.groupBy("cohort", "period_offset").agg(*aggs)
    size = g.where(F.col("period_offset") == 0).select("cohort", F.col("active_users").alias("cohort_size"))
    return g.join(size, "cohort").withColumn("retention_pct", F.col("active_users") * 100.0 / F.col("cohort_size"))


def cohort_matrix(ret: DataFrame, max_offset: int = 12) -> DataFrame:
    """K1: retention % pivoted to one row per cohort (offsets 0..max_offset)."""
    return ret.where(F.col("period_offset") <= max_offset).groupBy("cohort").pivot(
        "period_offset", list(range(max_offset + 1))).agg(F.first("retention_pct"))


def root_cause_drivers(df: DataFrame, target: str, features: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """K2: numeric features with |corr(feature, target)| > threshold;
    confidence = min(|r|, 0.9); impact = r."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features])
    long = row.unpivot([], list(features), "factor", "r")
    return long.where(F.abs("r") > threshold).select(
        F.lit("driver").alias("kind"), "factor", F.col("r").alias("impact"),
        F.least(F.abs("r"), F.lit(0.9)).alias("confidence"))


def root_cause_periods(df: DataFrame, date: str, value: str, threshold_pct: float = 10.0) -> DataFrame:
    """K3: monthly mean of ``value``; months whose change vs the previous month
    exceeds ±threshold %."""
    m = df.groupBy(F.date_trunc("month", F.col(date)).alias("month")).agg(F.avg(value).alias("mean"))
    w = Window.orderBy("month")  # months: a bounded calendar
    prev = F.lag("mean").over(w)
    ch = m.withColumn("change_pct", (F.col("mean") - prev) / F.abs(prev) * 100)
    return ch.where(F.abs("change_pct") > threshold_pct).select(
        F.lit("period").alias("kind"), F.date_format("month", "yyyy-MM").alias("factor"),
        (F.col("change_pct") / 100).alias("impact"), F.lit(0.7).alias("confidence"))


def root_cause_segments(df: DataFrame, value: str, categoricals: Sequence[str], min_count: int = 5,
                        threshold: float = 0.2, top: int | None = 10) -> DataFrame:
    """K4: for every value of each categorical column, (mean - overall) /
    overall; kept when |.| > 20 % and count >= 5; confidence min(0.8, n/50).
    The ``top`` largest, all for None."""
    overall = df.agg(F.avg(value)).scalar()
    long = df.select(F.col(value).cast("double").alias("x"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in categoricals])).alias("d")
    ).select("x", "d.*").where(F.col("category").isNotNull())
    g = long.groupBy("column", "category").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("impact", (F.col("mean") - overall) / overall)
    g = g.where((F.abs("impact") > threshold) & (F.col("n") >= min_count))
    out = g.select(F.lit("segment").alias("kind"), F.concat_ws("=", "column", "category").alias("factor"), "impact",
                   F.least(F.lit(0.8), F.col("n") / 50.0).alias("confidence"))
    return out if top is None else out.orderBy(F.desc(F.abs("impact")), "factor").limit(top)


def root_cause(parts: Sequence[DataFrame], keep: int = 5) -> DataFrame:
    """K5: union findings, rank by |impact| x confidence; rank 1 is primary."""
    u = reduce(DataFrame.unionByName, parts)
    score = F.abs("impact") * F.col("confidence")
    top = u.withColumn("score", score).orderBy(F.desc("score"), "kind", "factor").limit(keep)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "factor")))


def trend_detection(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """K6: strength |corr(position, x)| (< 0.3 stable), direction, volatile
    when std/mean > 0.5, change between the first and last 10 % means."""
    r = win.ranked(df, order)
    pos = F.col("_rn") - F.col("_g0")
    x = F.col(value).cast("double")
    tenth = F.greatest(F.floor(F.col("_gn") / 10), F.lit(1))
    s = r.agg(F.corr(pos.cast("double"), x).alias("r"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
              F.avg(F.when(pos <= tenth, x)).alias("first_mean"),
              F.avg(F.when(pos > F.col("_gn") - tenth, x)).alias("last_mean"))
    return s.select(F.abs("r").alias("strength"),
                    F.when(F.abs("r") < 0.3, "stable").when(F.col("r") > 0, "increasing").otherwise("decreasing").alias("trend"),
                    (F.col("std") / F.abs("mean") > 0.5).alias("volatile"),
                    ((F.col("last_mean") - F.col("first_mean")) / F.abs("first_mean") * 100).alias("change_pct"))


def trend_anomalies(df: DataFrame, value: str, key: str, top: int = 5) -> DataFrame:
    """K7: IQR (1.5) outliers, the ``top`` by |x - mean| / std, tagged high/low."""
    from kestrel.plans.distributed import exact_quantiles
    x = F.col(value).cast("double")
    q = stats_scalar(exact_quantiles(df, value, [0.25, 0.75], names=["q1", "q3"]))
    m = stats_scalar(df.agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd")))
    iqr = q["q3"] - q["q1"]
    out = df.where((x < q["q1"] - 1.5 * iqr) | (x > q["q3"] + 1.5 * iqr)).select(
        key, x.alias("value"), (F.abs(x - m["mu"]) / m["sd"]).alias("z"),
        F.when(x > m["mu"], "high").otherwise("low").alias("direction"))
    return out.orderBy(F.desc("z"), key).limit(top)


_OPS = {"gt": lambda v, t: v > t, "lt": lambda v, t: v < t, "eq": lambda v, t: v == t,
        "gte": lambda v, t: v >= t, "lte": lambda v, t: v <= t}


def latest_and_previous(df: DataFrame, metrics: Sequence[str], order: str) -> DataFrame:
    """One row: the latest and the previous value of each metric (by ``order``)."""
    top2 = df.orderBy(F.desc(order)).limit(2)
    w = Window.orderBy(F.desc(order))  # two rows
    t = top2.withColumn("_r", F.row_number().over(w))
    return t.agg(*[F.max(F.when(F.col("_r") == 1, F.col(m))).alias(m) for m in metrics],
                 *[F.max(F.when(F.col("_r") == 2, F.col(m))).alias(f"{m}__prev") for m in metrics])


def threshold_alerts(df: DataFrame, rules: Sequence[Mapping], order: str) -> DataFrame:
    """K8: rules {name, metric, condition, threshold, priority} evaluated on the
    latest row: gt/lt/eq/gte/lte on the value, change_pct / drop_pct /
    increase_pct against the previous value.  Only triggered rules are kept."""
    metrics = sorted({r["metric"] for r in rules})
    lp = latest_and_previous(df, metrics, order)
    items = []
    for r in rules:
        v, p, t = F.col(r["metric"]), F.col(r["metric"] + "__prev"), F.lit(float(r["threshold"]))
        ch = (v - p) / F.abs(p) * 100
        cond = r["condition"]
        if cond in _OPS:
            hit, val = _OPS[cond](v, t), v
        elif cond == "change_pct":
            hit, val = F.abs(ch) >= t, ch
        elif cond == "drop_pct":
            hit, val = -ch >= t, ch
        else:
            hit, val = ch >= t, ch
        items.append(F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["metric"]).alias("metric"),
                              F.lit(cond).alias("condition"), val.cast("double").alias("value"),
                              t.alias("threshold"), F.lit(r.get("priority", "medium")).alias("priority"),
                              F.coalesce(hit, F.lit(False)).alias("triggered")))
    return lp.select(F.explode(F.array(*items)).alias("a")).select("a.*").where("triggered")


def anomaly_alert(df: DataFrame, value: str, order: str) -> DataFrame:
    """K9: z of the latest value against all values (population std):
    > 3 high, > 2 medium, else none."""
    x = F.col(value).cast("double")
    s = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.max_by(x, F.col(order)).alias("latest"))
    z = (F.col("latest") - F.col("mu")) / F.col("sd")
    return s.select("latest", "mu", "sd", z.alias("z"),
                    F.when(F.abs(z) > 3, "high").when(F.abs(z) > 2, "medium").alias("severity"))


def decline_alert(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Total change first -> last < -20 % with a negative slope
    (``regr_slope`` on position); high below -30 %."""
    r = win.ranked(df, order)
    x = F.col(value).cast("double")
    s = r.agg(F.min_by(x, "_rn").alias("first"), F.max_by(x, "_rn").alias("last"),
              F.regr_slope(x, F.col("_rn").cast("double")).alias("slope"))
    ch = (F.col("last") - F.col("first")) / F.abs("first") * 100
    return s.select("first", "last", "slope", ch.alias("change_pct"),
                    F.when((ch < -30) & (F.col("slope") < 0), "high").when((ch < -20) & (F.col("slope") < 0), "medium")
                    .alias("severity"))


def business_metrics(df: DataFrame, date: str, amount: str, customer: str, product: str, invoice: str) -> DataFrame:
    """Metrics row used by the insight rules: revenue / customers / orders of
    the last and previous 30 days, top product share, top-5 customer share,
    churn % (customers active in the previous window but not the last)."""
    ref = df.agg(F.max(date)).scalar()
    last = F.col(date) > ref - F.expr("INTERVAL 30 DAYS")
    prev = (F.col(date) <= ref - F.expr("INTERVAL 30 DAYS")) & (F.col(date) > ref - F.expr("INTERVAL 60 DAYS"))
    m = df.agg(F.sum(F.when(last, F.col(amount))).alias("rev_last"), F.sum(F.when(prev, F.col(amount))).alias("rev_prev"),
               F.count_distinct(F.when(last, F.col(customer))).alias("cust_last"),
               F.count_distinct(F.when(prev, F.col(customer))).alias("cust_prev"),
               F.count_distinct(F.when(last, F.col(invoice))).alias("orders_last"),
               F.count_distinct(F.when(prev, F.col(invoice))).alias("orders_prev"),
               F.sum(amount).alias("revenue"))
    pt = df.groupBy(product).agg(F.sum(amount).alias("t")).orderBy(F.desc("t"), product).limit(1).agg(F.sum("t").alias("top_product"))
    ct = df.groupBy(customer).agg(F.sum(amount).alias("t")).orderBy(F.desc("t"), customer).limit(5).agg(F.sum("t").alias("top5"))
    pc = df.where(prev).select(customer).distinct()
    lc = df.where(last).select(customer).distinct()
    churned = pc.join(lc, customer, "left_anti").agg(F.count(F.lit(1)).alias("churned"))
    one = lambda d, c: d.select(c).scalar()  # noqa: E731  one-row tables as scalar subqueries
    return m.select("*", (one(pt, "top_product") / F.col("revenue") * 100).alias("top_product_pct"),
                    (one(ct, "top5") / F.col("revenue") * 100).alias("top5_customer_pct"),
                    (one(churned, "churned") * 100.0 / F.col("cust_prev")).alias("churn_pct"))


def insight_rules(metrics: DataFrame) -> DataFrame:
    """Rule rows from a metrics row: revenue / customer / order change
    bands (±10 %), top product > 50 %, top-5 customers > 40 / 60 %, churn
    > 8 / 15 %.  (Margin needs a cost column and is skipped without one.)"""
    def ch(a, b):
        return (F.col(a) - F.col(b)) / F.abs(F.col(b)) * 100
    items = [
        ("revenue_change", ch("rev_last", "rev_prev"), F.when(ch("rev_last", "rev_prev") > 10, "opportunity")
         .when(ch("rev_last", "rev_prev") < -10, "risk")),
        ("customer_change", ch("cust_last", "cust_prev"), F.when(ch("cust_last", "cust_prev") > 10, "opportunity")
         .when(ch("cust_last", "cust_prev") < -10, "risk")),
        ("order_change", ch("orders_last", "orders_prev"), F.when(ch("orders_last", "orders_prev") > 10, "opportunity")
         .when(ch("orders_last", "orders_prev") < -10, "risk")),
        ("product_concentration", F.col("top_product_pct"), F.when(F.col("top_product_pct") > 50, "risk")),
        ("customer_concentration", F.col("top5_customer_pct"), F.when(F.col("top5_customer_pct") > 60, "risk")
         .when(F.col("top5_customer_pct") > 40, "warning")),
        ("churn", F.col("churn_pct"), F.when(F.col("churn_pct") > 15, "risk").when(F.col("churn_pct") > 8, "warning")),
    ]
    sev = {"risk": "high", "warning": "medium", "opportunity": "medium"}
    m = F.create_map(*[x for k, v in sev.items() for x in (F.lit(k), F.lit(v))])
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("insight"), v.cast("double").alias("value"),
                                                       k.alias("type")) for n, v, k in items])).alias("r")).select("r.*")
    return rows.where(F.col("type").isNotNull()).withColumn("severity", m[F.col("type")])


def insight_scores(insights: DataFrame) -> DataFrame:
    """risk = 10 + 30/20/10/5 per critical/high/medium/low risk;
    opportunity = 20 + 15 per opportunity; health = 70 - 0.3 risk + 0.1 opp + 5 per up-trend."""
    s = insights.agg(
        (F.lit(10) + F.sum(F.when(F.col("type") != "opportunity", F.when(F.col("severity") == "critical", 30)
                                  .when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 10).otherwise(5))
                           .otherwise(0))).alias("risk"),
        (F.lit(20) + 15 * F.count_if(F.col("type") == "opportunity")).alias("opportunity"),
        F.count_if((F.col("type") == "opportunity") & (F.col("value") > 0)).alias("ups"))
    s = s.withColumn("risk", F.least(F.coalesce("risk", F.lit(10)), F.lit(100))).withColumn(
        "opportunity", F.least("opportunity", F.lit(100)))
    return s.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(100.0),
                                             70 - 0.3 * F.col("risk") + 0.1 * F.col("opportunity") + 5 * F.col("ups"))))


def kpi_cards(df: DataFrame, date: str, value: str, order: Sequence[str]) -> DataFrame:
    """Tidy (kpi, value) rows: total, mean, median, p90, CAGR of yearly
    totals, z > 2.5 anomaly count, volatility (CV %), momentum of the last
    three months and QoQ growth of the positional quarters."""
    from kestrel.plans.distributed import exact_quantiles, written
    df = written(df.select(*dict.fromkeys([date, value, *order])), "cards")  # read for each of the figures below
    x = F.col(value).cast("double")
    base = df.agg(F.sum(x).alias("total"), F.avg(x).alias("mean"),
                  (F.stddev_samp(x) / F.abs(F.avg(x)) * 100).alias("volatility_pct"))
    q = exact_quantiles(df, value, [0.5, 0.9], names=["median", "p90"])
    s = stats_scalar(df.agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd")))
    anomalies = df.agg(F.count_if(F.abs(x - s["mu"]) / s["sd"] > 2.5).cast("double").alias("anomalies"))
    yearly = df.groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("t"))
    cg = win.cagr(yearly, "t", "year").select("cagr_pct")
    monthly = df.groupBy(F.date_trunc("month", F.col(date)).alias("month")).agg(F.sum(value).alias("t"))
    mom = win.momentum(monthly, "t", ["month"], 3).select(F.col("roc_pct").alias("momentum_pct"))
    fq = win.four_periods(df, value, order).where("period = 4").select(F.col("growth_pct").alias("qoq_growth_pct"))
    parts = [base, q, anomalies, cg, mom, fq]
    one = reduce(lambda a, b: a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k"), parts)
    cols = [c for c in one.columns]
    return one.unpivot([], cols, "kpi", "value")


def what_if(df: DataFrame, target: str, features: Sequence[str], scenarios: Sequence[Mapping]) -> DataFrame:
    """predicted = mean(target) + sum corr(f, target) * change_f * std(target)
    per scenario {name, column, change}; ranked by prediction."""
    aggs = [F.avg(target).alias("_mu"), F.stddev_samp(target).alias("_sd")]
    aggs += [F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f"r_{f}") for f in features]
    s = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(sc["name"]).alias("scenario"), F.lit(sc["column"]).alias("column"),
                             F.lit(float(sc["change"])).alias("change")) for sc in scenarios])
    x = s.select("*", F.explode(arr).alias("sc")).select("*", "sc.*").drop("sc")
    r = F.coalesce(*[F.when(F.col("column") == f, F.col(f"r_{f}")) for f in features], F.lit(0.0))
    pred = F.col("_mu") + r * F.col("change") * F.col("_sd")
    out = x.select("scenario", "column", "change", F.col("_mu").alias("baseline"), pred.alias("predicted"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("predicted"), "scenario")))  # scenarios


def elasticity(df: DataFrame, value: str, price_change: float = 0.0, marketing_change: float = 0.0,
               price_elasticity: float = -1.2, marketing_elasticity: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Volume effect = 1 + e_p * dp + e_m * dm; revenue effect also
    carries the price change: value * (1 + dp) * volume effect."""
    vol = 1 + price_elasticity * price_change + marketing_elasticity * marketing_change
    g = df.groupBy(*by).agg(F.sum(value).alias("baseline"))
    return g.withColumns({"volume_factor": F.lit(vol), "projected": F.col("baseline") * (1 + price_change) * vol,
                          "change_pct": F.lit(((1 + price_change) * vol - 1) * 100)})


def entity_report(df: DataFrame, entity: str, value: str, invoice: str, top: int = 5) -> DataFrame:
    """Top entities with totals, distinct orders and share of the total."""
    grand = df.agg(F.sum(value)).scalar()
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.sum(value).alias("total"), F.count_distinct(invoice).alias("orders"))
    return g.orderBy(F.desc("total"), entity).limit(top).withColumn("share_pct", F.col("total") / grand * 100)


def summary_text_rows(df: DataFrame, entity: str, value: str, top: int = 20, bottom: bool = False) -> DataFrame:
    """Text rows ('rank. entity: total') for the top (or bottom) entities."""
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.sum(value).alias("total"))
    o = [F.asc("total") if bottom else F.desc("total"), F.asc(entity)]
    t = g.orderBy(*o).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*o)))
    return t.select("rank", F.concat_ws("", F.col("rank").cast("string"), F.lit(". "), F.col(entity).cast("string"),
                                        F.lit(": "), F.format_number("total", 2)).alias("text"))


def period_report(df: DataFrame, date: str, value: str, invoice: str, customer: str, product: str,
                  days: int = 7) -> DataFrame:
    """Last ``days`` report: total, invoices, average, top customer and
    product, and growth vs the previous window."""
    ref = df.agg(F.max(date)).scalar()
    cur = df.where(F.col(date) > ref - F.make_interval(days=F.lit(days)))
    prev = df.where((F.col(date) <= ref - F.make_interval(days=F.lit(days)))
                    & (F.col(date) > ref - F.make_interval(days=F.lit(2 * days))))
    tc = cur.groupBy(customer).agg(F.sum(value).alias("t")).orderBy(F.desc("t"), customer).limit(1).select(customer).scalar()
    tp = cur.groupBy(product).agg(F.sum(value).alias("t")).orderBy(F.desc("t"), product).limit(1).select(product).scalar()
    pv = prev.agg(F.sum(value)).scalar()
    return cur.agg(F.sum(value).alias("total"), F.count_distinct(invoice).alias("invoices")).select(
        "total", "invoices", (F.col("total") / F.col("invoices")).alias("avg_invoice"),
        tc.cast("string").alias("top_customer"), tp.cast("string").alias("top_product"),
        ((F.col("total") - pv) / F.abs(pv) * 100).alias("growth_pct"))


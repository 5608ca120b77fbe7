"""One overview of any table: roles of its columns, then KPIs, trend,
comparison, distribution, ranked rows, crosstab, spread, top lists and slicers.

The roles, one row per column, are the only thing the driver reads; every widget is a
DataFrame of (section, item, measure, value) over the whole table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import scalars
from kestrel.operators import schema as sch
from kestrel.operators.reports import _ranked_list, _tidy, _union
from kestrel.plans.distributed import exact_quantiles, global_rank, stats_scalar, top_k_per_group, written

# fixed values: names of time columns, metrics, identifiers, metrics that are averaged, and domains in order
TIME_NAMES = ("date", "time", "year", "month", "day", "created", "updated")
METRIC_NAMES = ("amount", "price", "cost", "revenue", "sales", "profit", "score", "grade", "gpa", "salary", "age",
                "quantity", "count")
IDENTIFIER_NAMES = ("id", "code", "email")
AVERAGED = ("gpa", "score", "rating", "rate", "age", "percent")
DOMAINS = {"HR": ("employee", "salary", "department", "hr", "hire"),
           "Education": ("student", "grade", "score", "course", "gpa", "enrollment"),
           "Sales": ("revenue", "sales", "customer", "product", "order"),
           "Healthcare": ("patient", "diagnosis", "treatment", "medical")}
COUNT_LABEL = {"Education": "Total Enrollment", "HR": "Total Headcount"}


def to_number(f: T.StructField) -> Column:
    """The value as a number, texts without currency marks, separators and percent signs; 0 where there is none."""
    c = F.col(f"`{f.name}`")
    if sch.is_number(f.dataType):
        x = c.cast("double")
    elif isinstance(f.dataType, T.StringType):
        x = F.regexp_replace(c, r"[\$,€£¥₹\s%]", "").try_cast("double")
    else:
        return F.lit(0.0)
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def to_time(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if sch.is_time(f.dataType):
        return c.cast("timestamp")
    if isinstance(f.dataType, T.StringType):
        return scalars.parse_mixed_date(c).cast("timestamp")
    return F.lit(None).cast("timestamp")


def overview_roles(df: DataFrame) -> DataFrame:
    """K15 roles: a row per column with position, role, distinct values, share of missing
    ones, and variance, total and mean read as numbers.

    time: named like one and over half its values are times (numbers are not);
    metric: over 30 % of the values are numbers other than 0 and over 10 differ, or it is
    named like a metric; identifier: as many values as rows, or named like one;
    dimension: 1 to 50 values; else text.  An empty table: identifier or metric by name alone."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        x = to_number(f)
        aggs += [F.count_if(sch.missing(f)).alias(f"m{i}"), F.count_if(x != 0).alias(f"z{i}"),
                 F.count_if(to_time(f).isNotNull()).alias(f"t{i}"), F.var_samp(x).alias(f"v{i}"),
                 F.sum(x).alias(f"s{i}"), F.avg(x).alias(f"a{i}")]
    long = df.agg(*aggs).select("_n", F.explode(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.col(f"m{i}").alias("_m"), F.col(f"z{i}").alias("_z"),
        F.col(f"t{i}").alias("_t"), F.col(f"v{i}").alias("variance"), F.col(f"s{i}").alias("total"), F.col(f"a{i}").alias("mean"),
        F.lit(sch.holds(f.name, TIME_NAMES)).alias("_time"), F.lit(sch.holds(f.name, METRIC_NAMES)).alias("_metric"),
        F.lit(sch.holds(f.name, IDENTIFIER_NAMES)).alias("_id")) for i, f in enumerate(fields)])).alias("c")).select("_n", "c.*")
    n = sch.frequency(df, [f.name for f in fields]).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))
    out = long.join(n, "column", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    card = F.col("cardinality")
    role = (F.when(F.col("_time") & (F.col("_t") > F.col("_n") * 0.5), "time")
            .when(((F.col("_z") > F.col("_n") * 0.3) & (card > 10)) | F.col("_metric"), "metric")
            .when((card == F.col("_n")) | F.col("_id"), "identifier")
            .when(card.between(1, 50), "dimension").otherwise("text"))
    out = out.withColumn("role", role)
    metric = F.col("role") == "metric"
    return out.select("position", "column", "role", "cardinality",
                      F.coalesce(F.try_divide("_m", "_n"), F.lit(0.0)).alias("null_ratio"),
                      *[F.when(metric, F.col(c)).alias(c) for c in ("variance", "total", "mean")])


@dataclass
class Roles:
    """The columns of an overview; metrics by falling variance, the others in table order."""
    metrics: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    time: str | None = None
    identifier: str | None = None
    cardinality: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, roles: DataFrame) -> "Roles":
        rows = sorted(roles.collect(), key=lambda r: r["position"])  # one row per column
        by = lambda role: [r["column"] for r in rows if r["role"] == role]
        variance = {r["column"]: r["variance"] or 0.0 for r in rows}
        return cls(sorted(by("metric"), key=lambda c: -variance[c]), by("dimension"), next(iter(by("time")), None),
                   next(iter(by("identifier")), None), {r["column"]: r["cardinality"] for r in rows})


def domain(names: list[str]) -> str:
    text = " ".join(names).lower()
    return next((d for d, parts in DOMAINS.items() if any(p in text for p in parts)), "Analytics")


def _halves(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric the change in percent of its mean from the rows before the middle row's time to the
    others; the middle time is found on running counts of the distinct times, not by a sort of the rows."""
    d = df.where(F.col("_time").isNotNull())
    counts = d.groupBy("_time").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    run = global_rank(counts, ["_time"], running={"_n": "_cum"})
    half = F.floor(run.agg(F.sum("_n")).scalar() / 2)
    mid = run.where(F.col("_cum") > half).agg(F.min("_time")).scalar()
    early = F.col("_time") < mid
    out = []
    for m in metrics:
        a, b = F.avg(F.when(early, F.col(m))), F.avg(F.when(~early, F.col(m)))
        out.append(F.when(a == 0, F.when(b.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(b - a, a) * 100).alias(m))
    return d.agg(*out)


def unified_overview(df: DataFrame, roles: Roles | None = None, top: int = 5, points: int = 20, ranked: int = 6,
                     lines: int = 5) -> DataFrame:
    """The whole overview of ``df`` as (section, item, measure, value).

    kpis: the two metrics of largest variance (total, or mean for rates and scores) with the
    change of their means between the halves in time, the rows, the first dimension's values;
    trend: mean of the first metric per month (per day up to 300 dated rows), a line per value of the
    first dimension if it has at most ``lines``, the last ``points`` of each; comparison and top
    lists: the ``top`` values by mean; distribution: the ``top`` values of the second
    dimension by rows; ranked: the ``ranked`` largest rows; crosstab: rows of each pair of values of the
    first two dimensions; spread: five numbers and mean; slicers: ends of the time and values of the dimensions.

    A section whose columns the table lacks is left out.  Nulls are no group and count 0 in a metric.
    A change that cannot be known is absent; nothing is made up in its place."""
    r = roles or Roles.of(overview_roles(df))
    kinds = {f.name: f for f in df.schema.fields}
    metrics, dims = r.metrics[:2], r.dimensions[:2]
    label = r.identifier or next(iter(dims), None)
    picked = [F.col(f"`{d}`").cast("string").alias(f"_d{i}") for i, d in enumerate(dims)]
    picked += [to_number(kinds[m]).alias(f"_m{i}") for i, m in enumerate(metrics)]
    if r.time:
        picked.append(to_time(kinds[r.time]).alias("_time"))
    if label:
        picked.append(F.col(f"`{label}`").cast("string").alias("_label"))
    base = written(df.select(*picked), "overview") if picked else df  # read for each widget
    what = domain(df.columns)

    titles = []
    aggs = []
    for i, m in enumerate(metrics):
        mean = sch.holds(m, AVERAGED)
        titles.append(("Avg " if mean else "Total ") + m.replace("_", " ").title())
        aggs.append((F.avg(f"_m{i}") if mean else F.coalesce(F.sum(f"_m{i}"), F.lit(0.0))).alias(f"k{i}"))
    titles.append(COUNT_LABEL.get(what, "Total Records"))
    aggs.append(F.count(F.lit(1)).alias(f"k{len(metrics)}"))
    k = base.agg(*aggs)
    parts = [_tidy(k, "kpis", F.lit(t), [f"k{i}"]).withColumn("measure", F.lit("value")) for i, t in enumerate(titles)]
    if metrics and r.time:
        h = _halves(base, [f"_m{i}" for i in range(len(metrics))])
        parts += [_tidy(h, "kpis", F.lit(titles[i]), [f"_m{i}"]).withColumn("measure", F.lit("change_pct"))
                  for i in range(len(metrics))]
    if dims:
        c = base.where(F.col("_d0").isNotNull()).groupBy("_d0").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("value"))
        parts.append(_tidy(c, "kpis", F.lit(dims[0].replace("_", " ").title() + "s"), ["value"]))

    if metrics and r.time:
        dated = base.where(F.col("_time").isNotNull())
        monthly = dated.agg(F.count(F.lit(1)) > 300).scalar()
        period = F.when(monthly, F.date_format("_time", "yyyy-MM")).otherwise(F.date_format("_time", "yyyy-MM-dd"))
        multi = bool(dims) and r.cardinality.get(dims[0], lines + 1) <= lines
        line = F.col("_d0") if multi else F.lit("Average")
        t = dated.where(line.isNotNull()).groupBy(line.alias("line"), period.alias("period")).agg(F.avg("_m0").alias("mean"))
        t = top_k_per_group(t, ["line"], [F.desc("period")], points)
        parts.append(_tidy(t, "trend", F.concat_ws("/", "line", "period"), ["mean"]))

    if metrics:
        for i, d in enumerate(dims):
            g = base.where(F.col(f"_d{i}").isNotNull()).groupBy(F.col(f"_d{i}").alias("entity")).agg(F.avg("_m0").alias("total"))
            best = _tidy(_ranked_list(g, top), "comparison", "entity", ["total", "rank"])
            if i == 0:
                parts.append(best)
            parts.append(best.withColumn("section", F.lit(f"top_{d}")))
        if label:
            order = [F.desc("_m0"), F.asc("_label")]
            best = base.select("_label", "_m0").orderBy(*order).limit(ranked)
            best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``ranked`` rows
            parts.append(_tidy(best, "ranked", F.concat_ws(". ", F.col("rank").cast("string"), "_label"), ["_m0"]).withColumn(
                "measure", F.lit(metrics[0])))
        q = exact_quantiles(base, "_m0", [0.0, 0.25, 0.5, 0.75, 1.0], names=["min", "q1", "median", "q3", "max"])
        parts += [_tidy(q, "spread", F.lit(metrics[0]), ["min", "q1", "median", "q3", "max"]),
                  _tidy(base.agg(F.avg("_m0").alias("mean")), "spread", F.lit(metrics[0]), ["mean"])]
    if dims:
        d = f"_d{len(dims) - 1}"
        g = base.where(F.col(d).isNotNull()).groupBy(F.col(d).alias("entity")).agg(F.count(F.lit(1)).alias("total"))
        parts.append(_tidy(_ranked_list(g, top), "distribution", "entity", ["total", "rank"]))
    if len(dims) == 2:
        x = base.where(F.col("_d0").isNotNull() & F.col("_d1").isNotNull()).groupBy("_d0", "_d1").agg(
            F.count(F.lit(1)).alias("count"))
        parts.append(_tidy(x, "crosstab", F.concat_ws("/", "_d0", "_d1"), ["count"]))
    if r.time:
        ends = base.agg(F.min("_time").cast("double").alias("from"), F.max("_time").cast("double").alias("to"))
        parts.append(_tidy(ends, "slicers", F.lit(r.time), ["from", "to"]))
    if r.dimensions:
        values = sch.frequency(df, r.dimensions)
        parts.append(_tidy(values, "slicers", F.concat_ws("=", "column", "value"), ["n"]))
    return _union(parts)

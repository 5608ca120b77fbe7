"""Chart-ready aggregates.  Rendering is not built; each
function returns a bounded tidy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators import aggregate as agg
from kestrel.operators import windows as win
from kestrel.operators.frame import topk_keys
from kestrel.plans.distributed import exact_quantiles, global_rank


def bar(df: DataFrame, category: str, value: str, top: int = 10) -> DataFrame:
    """Q1: group sums, top ``top`` with percent of the grand total."""
    g = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(value).alias("value"))
    grand = g.agg(F.sum("value")).scalar()
    return g.orderBy(F.desc("value"), category).limit(top).withColumn("percent", F.col("value") / grand * 100)


def heatmap(df: DataFrame, row: str, col: str, value: str | None = None, top: int = 10) -> DataFrame:
    """Q2: stacked/grouped bar and heatmap cells (D12 on top categories)."""
    return agg.crosstab(df, row, col, value, top=top)


def funnel(df: DataFrame, stage: str, top: int = 6) -> DataFrame:
    """Q3: counts of the ``top`` stages, largest first, with conversion vs the first."""
    g = df.groupBy(stage).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), stage).limit(top)
    first = g.agg(F.max("count")).scalar()
    return g.withColumn("conversion_pct", F.col("count") / first * 100)


def waterfall(df: DataFrame, category: str, value: str) -> DataFrame:
    """Q5: category totals with the running total before / after each bar, running on a range
    scan, so the categories may be many."""
    g = df.groupBy(category).agg(F.sum(value).alias("delta"))
    r = global_rank(g, [category], out="_rn", running={"delta": "end"}).drop("_rn")
    return r.withColumn("start", F.col("end") - F.col("delta"))


def radar(df: DataFrame, item: str, metrics: Sequence[str], top: int = 3) -> DataFrame:
    """Q6: top items by the first metric; each metric normalised by its
    column total x 5."""
    g = df.groupBy(item).agg(*[F.sum(m).alias(m) for m in metrics])
    tot = g.agg(*[F.sum(m).alias(m) for m in metrics])
    s = tot.select(F.struct(*metrics).alias("t")).scalar()
    t = g.orderBy(F.desc(metrics[0]), item).limit(top)
    return t.select(item, *[(F.col(m) / s[m] * 5).alias(m) for m in metrics])


def sankey(df: DataFrame, source: str, target: str, value: str, top: int = 50) -> DataFrame:
    """Q7: source x target sums, top 50 links, dense node indices."""
    g = df.groupBy(source, target).agg(F.sum(value).alias("value")).orderBy(F.desc("value"), source, target).limit(top)
    nodes = g.select(F.col(source).cast("string").alias("node")).union(g.select(F.col(target).cast("string").alias("node"))).distinct()
    idx = nodes.withColumn("idx", F.dense_rank().over(Window.orderBy("node")) - 1)  # <= 100 nodes
    j = g.join(idx.withColumnRenamed("node", "_s").withColumnRenamed("idx", "source_idx"), F.col(source).cast("string") == F.col("_s"))
    j = j.join(idx.withColumnRenamed("node", "_t").withColumnRenamed("idx", "target_idx"), F.col(target).cast("string") == F.col("_t"))
    return j.select(source, target, "value", "source_idx", "target_idx")


def ohlc(df: DataFrame, ts: str, price: str, freq: str = "day") -> DataFrame:
    """Q8: open / high / low / close per period from ticks (first and last by time)."""
    return df.groupBy(F.date_trunc(freq, F.col(ts)).alias("period")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, ts).alias("close"))


def calendar(df: DataFrame, ts: str, value: str | None = None) -> DataFrame:
    """Q10: daily sum (or count)."""
    m = F.sum(value) if value else F.count(F.lit(1))
    return df.groupBy(F.to_date(F.col(ts)).alias("day")).agg(m.alias("value"))


def diverging(df: DataFrame, category: str, value: str) -> DataFrame:
    """Q12: group mean minus the mean of the group means."""
    g = df.groupBy(category).agg(F.avg(value).alias("mean"))
    mu = g.agg(F.avg("mean")).scalar()
    return g.withColumn("deviation", F.col("mean") - mu)


def two_metrics(df: DataFrame, category: str, a: str, b: str, k: int = 10) -> DataFrame:
    """Q11: combo / slope / dumbbell: two sums per category, first k keys in order."""
    return df.groupBy(category).agg(F.sum(a).alias(a), F.sum(b).alias(b)).orderBy(category).limit(k)


def gauge(df: DataFrame, value: str) -> DataFrame:
    """Q14: gauge value (mean) and target (0.8 x max)."""
    return df.agg(F.avg(value).alias("value"), (F.max(value) * 0.8).alias("target"))


def scatter_sample(df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 500, size: str | None = None) -> DataFrame:
    """Q15: seeded exact-n sample of points with size normalised to [0, 1]."""
    from kestrel.sources.files import sample_exact
    s = sample_exact(df, n, key)
    cols = [x, y]
    if size:
        st = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).select(F.struct("lo", "hi").alias("s")).scalar()
        s = s.withColumn("size_norm", (F.col(size) - st["lo"]) / (st["hi"] - st["lo"]))
        cols.append("size_norm")
    return s.select(*key, *cols)


def sunburst(df: DataFrame, parent: str, child: str, value: str, top: int = 15) -> DataFrame:
    """Q16: parent totals plus the top children of every parent (salted top-k)."""
    from kestrel.plans.distributed import top_k_per_group
    p = df.groupBy(parent).agg(F.sum(value).alias("value")).select(
        F.lit(None).cast("string").alias("parent"), F.col(parent).cast("string").alias("node"), "value")
    c = df.groupBy(parent, child).agg(F.sum(value).alias("value"))
    c = top_k_per_group(c, [parent], [F.desc("value"), F.asc(child)], top)
    return p.unionByName(c.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("node"), "value"))


def trend_band(df: DataFrame, value: str, order: Sequence[str], segments: int = 30) -> DataFrame:
    """Q13: band / step / area series from E13 segments."""
    return win.segments(df, value, order, segments)


def confidence_band(df: DataFrame, value: str, order: Sequence[str], points: int = 30) -> DataFrame:
    """Q13: (point, mean, lower, upper) of ``points`` runs of equal length over the rows in
    ``order`` (unique), the band being one population deviation wide on each side.  A null
    value counts as 0; rows beyond ``points`` whole runs are no part of a run, and a table of
    fewer rows has a point per row."""
    r = global_rank(df.select(*order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")), list(order), out="_rn")
    n = r.agg(F.count(F.lit(1))).scalar()
    used = F.least(F.lit(points), n)
    run = F.floor((F.col("_rn") - 1) / F.greatest(F.lit(1), F.floor(F.try_divide(n, used)))).cast("int") + 1
    g = r.withColumn("point", run).where(F.col("point") <= used).groupBy("point").agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("_sd"))
    return g.select("point", "mean", (F.col("mean") - F.col("_sd")).alias("lower"), (F.col("mean") + F.col("_sd")).alias("upper"))


def violin(df: DataFrame, category: str, value: str, top: int = 5, bins: int = 20) -> DataFrame:
    """Q14: per one of the ``top`` most frequent categories (ties by name) the five numbers and
    the mean, and the shape: (bin, count) of ``bins`` equal bins between its own minimum and
    maximum, empty ones left out; a category of one value has one bin.  Quartiles are exact and
    come from a range scan; rows without a value are left out."""
    names = topk_keys(df, category, top)
    rows = df.join(F.broadcast(names), category).where(F.col(value).isNotNull()).select(  # top rows: bounded
        F.col(category).alias("category"), F.col(value).cast("double").alias("x"))
    q = exact_quantiles(rows, "x", [0.25, 0.5, 0.75], by=["category"], names=["q1", "median", "q3"])
    st = rows.groupBy("category").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
                                      F.count(F.lit(1)).alias("n")).join(q, "category")
    width = (F.col("max") - F.col("min")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("min")) / width))).otherwise(0).cast("int")
    ends = F.broadcast(st.select("category", "min", "max"))
    shape = rows.join(ends, "category").groupBy("category", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    shape = shape.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("shape"))  # <= bins
    return st.join(shape, "category").select("category", "n", "min", "q1", "median", "q3", "max", "mean", "shape")


def bullet(df: DataFrame, value: str, target: str, order: Sequence[str]) -> DataFrame:
    """Q14: the latest ``value`` by ``order`` against the latest ``target``, the ends of the two
    bands (0.7 x target, target) and of the axis (1.2 x target).  An empty table has 0 throughout."""
    last = df.agg(F.max_by(F.struct(F.col(value).cast("double").alias("v"), F.col(target).cast("double").alias("t")),
                           F.struct(*order)).alias("l"))
    v, t = F.coalesce(F.col("l.v"), F.lit(0.0)), F.coalesce(F.col("l.t"), F.col("l.v") * 1.1, F.lit(0.0))
    return last.select(v.alias("value"), t.alias("target"), (t * 0.7).alias("low_end"), (t * 1.2).alias("axis_end"))

"""Univariate feature selection and distribution transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.plans.distributed import global_rank

# fixed values: Acklam's rational approximation of the normal quantile (relative error 1.15e-9)
PROBIT_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PROBIT_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
EDGE = 1e-7  # quantiles nearer to 0 or 1 are held there, so that scores stay finite


def contingency(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Rows (feature, bin, label, n, sum, sum of squares) of all features at once: one
    aggregate for the ranges, then one unpivoted pass, combined before the shuffle.
    ``bin`` splits the range of a feature into ``bins`` equal widths."""
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    ranges = df.where(F.col(f"`{label}`").isNotNull()).agg(*[g(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, g in (("lo", F.min), ("hi", F.max))])
    span = ranges.select(F.struct("*").alias("s")).scalar()
    cells = []
    for i, (f, x) in enumerate(zip(features, xs)):
        lo, hi = span[f"lo{i}"], span[f"hi{i}"]
        place = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
        cells.append(F.struct(F.lit(f).alias("feature"), place.alias("bin"), x.alias("x")))
    long = df.select(F.col(f"`{label}`").alias("label"), F.explode(F.array(*cells)).alias("c")).where("label IS NOT NULL AND c.x IS NOT NULL")
    return long.groupBy("c.feature", "c.bin", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.x").alias("s"), F.sum(F.col("c.x") * F.col("c.x")).alias("q"))


def univariate_scores(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """P10: per feature the mutual information of its bins with the label (nats), the
    ANOVA F of its values over the labels, Pearson's r with a numeric label (null for
    another) and the rank by each, ties by name.  All follow from one contingency table,
    of features x bins x labels rows.

    Rows without a label or a value are left out of that feature; a feature with one
    value has MI 0 and F and r null, ranked last; an empty table gives no rows."""
    cells = contingency(df, features, label, bins)
    number = dict(df.dtypes)[label] not in ("string", "boolean", "date", "timestamp")
    total = cells.groupBy("feature").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_label = cells.groupBy("feature", "label").agg(F.sum("n").alias("nl"), F.sum("s").alias("sl"))
    share = F.col("n") / F.col("all_n")
    mi = (cells.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "label"]).join(total, "feature")
          .groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(share * F.log(F.col("n") * F.col("all_n") / (F.col("nb") * F.col("nl"))))).alias("mi")))
    y = F.col("label").cast("double") if number else F.lit(None).cast("double")
    groups = by_label.join(total, "feature").groupBy("feature").agg(
        F.first("all_n").alias("all_n"), F.first("all_s").alias("all_s"), F.first("all_q").alias("all_q"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("sl") * F.col("sl") / F.col("nl")).alias("B"), F.sum(y * F.col("nl")).alias("Y"),
        F.sum(y * y * F.col("nl")).alias("YY"), F.sum(y * F.col("sl")).alias("XY"))
    between, within = F.col("B") - F.col("all_s") * F.col("all_s") / F.col("all_n"), F.col("all_q") - F.col("B")
    f = F.when((F.col("k") > 1) & (F.col("all_n") > F.col("k")) & (within > 0),
               (between / (F.col("k") - 1)) / (within / (F.col("all_n") - F.col("k"))))
    vx, vy = F.col("all_n") * F.col("all_q") - F.col("all_s") * F.col("all_s"), F.col("all_n") * F.col("YY") - F.col("Y") * F.col("Y")
    r = F.when((vx > 0) & (vy > 0), (F.col("all_n") * F.col("XY") - F.col("all_s") * F.col("Y")) / F.sqrt(vx * vy))
    scores = groups.select("feature", F.col("all_n").alias("rows"), f.alias("f_score"), r.alias("correlation")).join(mi, "feature")

    def rank(c: Column) -> Column:  # one row per feature
        all_ = F.array_sort(F.collect_list(F.struct((-F.coalesce(c, F.lit(-1.0))).alias("o"), F.col("feature").alias("f"))))
        return F.transform(all_, lambda x: x["f"])

    orders = scores.agg(rank(F.col("mi")).alias("m"), rank(F.col("f_score")).alias("f"), rank(F.abs("correlation")).alias("c"))
    order = orders.select(F.struct("*").alias("s")).scalar()
    return scores.select("feature", "rows", "mi", "f_score", "correlation", *[
        F.array_position(order[k], F.col("feature")).cast("int").alias(f"{n}_rank") for k, n in (("m", "mi"), ("f", "f"), ("c", "correlation"))])


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int, by: str = "mi", bins: int = 10) -> list[str]:
    """P10: the names of the ``k`` best features by ``mi``, ``f`` or ``correlation``."""
    rows = univariate_scores(df, features, label, bins).where(F.col(f"{by}_rank") <= k).orderBy(f"{by}_rank").collect()
    return [r["feature"] for r in rows]


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share ``p`` lies."""
    given, p = p, F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    q = p - 0.5
    r = q * q
    middle = _horner(PROBIT_A, r) * q / (_horner(PROBIT_B, r) * r + 1.0)

    def tail(share: Column) -> Column:
        t = F.sqrt(-2.0 * F.log(share))
        return _horner(PROBIT_C, t) / (_horner(PROBIT_D, t) * t + 1.0)

    return F.when(given.isNull(), F.lit(None)).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def quantile_transform(df: DataFrame, column: str) -> DataFrame:
    """``quantile`` (mean rank of equal values, from 0 to 1) and ``normal_score`` of a
    numeric column; null for null.

    Values are counted first, so equal values meet as one row; the counts get running
    sums from a range-partitioned scan, and each row looks its value up (a value that
    many rows share is a skewed join key that AQE splits).  A single row has 0.5."""
    x = F.col(f"`{column}`").cast("double")
    counts = df.select(x.alias("_x")).where("_x IS NOT NULL").groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    ranks = global_rank(counts, ["_x"], out="_r", running={"_c": "_to"}).withColumn("_n", F.lit(0))
    n = counts.agg(F.sum("_c")).scalar()
    mean_rank = F.col("_to") - (F.col("_c") + 1) / 2.0  # from 0
    q = F.when(n > 1, mean_rank / (n - 1)).otherwise(0.5)
    table = ranks.select("_x", q.alias("quantile"))
    return df.withColumn("_x", x).join(table, "_x", "left").drop("_x").withColumn("normal_score", normal_quantile(F.col("quantile")))


def yeo_johnson(x: Column, power: float | Column) -> Column:
    if isinstance(power, Column):
        up = F.when(power != 0, (F.pow(x + 1, power) - 1) / power).otherwise(F.log1p(x))
        down = F.when(power != 2, -(F.pow(1 - x, 2 - power) - 1) / (2 - power)).otherwise(-F.log1p(-x))
    else:
        up = (F.pow(x + 1, F.lit(power)) - 1) / power if power else F.log1p(x)
        down = -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power) if power != 2 else -F.log1p(-x)
    return F.when(x >= 0, up).otherwise(down)


GRID = tuple(round(-2 + i / 10, 1) for i in range(41))


def power_fit(df: DataFrame, columns: Sequence[str], grid: Sequence[float] = GRID) -> DataFrame:
    """Per column the Yeo-Johnson power of the greatest likelihood on ``grid`` (of
    equals the least), with the mean and deviation of the transformed values: the
    variances for all powers and columns come from one aggregate, one row to nobody.

    A constant or empty column has null for all three."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), (F.max(x) > F.min(x)).alias(f"w{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}")]
        for k, p in enumerate(grid):
            aggs += [F.var_pop(yeo_johnson(x, p)).alias(f"v{i}_{k}"), F.avg(yeo_johnson(x, p)).alias(f"m{i}_{k}")]
    row = df.agg(*aggs)
    out = []
    for i, c in enumerate(columns):
        n, j = F.col(f"n{i}"), F.col(f"j{i}")
        fits = [F.when(F.col(f"w{i}") & (F.col(f"v{i}_{k}") > 0), F.struct((-n / 2 * F.log(F.col(f"v{i}_{k}")) + (p - 1) * j).alias("fit"), F.lit(-float(p)).alias("o"),
                                                        F.col(f"m{i}_{k}").alias("mean"), F.sqrt(f"v{i}_{k}").alias("sd"))) for k, p in enumerate(grid)]
        out.append(F.struct(F.lit(c).alias("column"), F.array_max(F.array(*fits)).alias("b")))
    best = row.select(F.explode(F.array(*out)).alias("e")).select("e.column", "e.b")
    return best.select("column", (-F.col("b.o")).alias("power"), F.col("b.mean").alias("mean"), F.col("b.sd").alias("sd"))


def power_transform(df: DataFrame, columns: Sequence[str], grid: Sequence[float] = GRID) -> DataFrame:
    """``<column>_power``, the standardised transform by the fitted power; null for
    null, 0 in a constant column."""
    fits = power_fit(df, columns, grid).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("power", "mean", "sd")))).alias("m"))
    fit = fits.scalar()
    out = df
    for c in columns:
        x, own = F.col(f"`{c}`").cast("double"), fit[c]
        z = (yeo_johnson(x, own["power"]) - own["mean"]) / own["sd"]
        out = out.withColumn(f"{c}_power", F.when(x.isNotNull(), F.coalesce(z, F.lit(0.0))))
    return out

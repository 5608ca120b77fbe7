"""Time series and forecasting.

Fits are closed-form aggregates per series (``regr_*`` and power sums), the
horizon is an exploded ``sequence``; only Holt-Winters runs as a grouped
pandas function, one series per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import windows as win

Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def prepare(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """L1: value coerced to double, null rows dropped, 0-based position ``t``
    per series in time order (global-rank based, no hot-series task)."""
    base = df.select(*by, F.col(ts).alias("ts"), F.col(value).cast("string").try_cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.col("ts").isNotNull())
    r = win.ranked(base, ["ts"], by)
    return r.select(*by, "ts", "y", (F.col("_rn") - F.col("_g0") - 1).alias("t"))


def _fit(p: DataFrame, by: Sequence[str]) -> DataFrame:
    t, y = F.col("t").cast("double"), F.col("y")
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"),
        F.regr_r2(y, t).alias("r2"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd_pop"),
        F.stddev_samp(y).alias("sd"), F.max_by(y, t).alias("last"), F.min_by(y, t).alias("first"),
        F.avg(F.when(t >= F.lit(0), y)).alias("_unused"),
        F.regr_sxx(y, t).alias("sxx"), F.regr_syy(y, t).alias("syy"), F.regr_sxy(y, t).alias("sxy"))


def linear_trend(p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """L2: OLS slope on position; relative slope = slope / mean classes:
    > 0.02 strong_up, > 0.005 up, < -0.02 strong_down, < -0.005 down, else stable."""
    f = _fit(p, by)
    rel = F.col("slope") / F.abs(F.col("mean"))
    return f.select(*by, "n", "slope", "intercept", rel.alias("relative_slope"),
                    F.when(rel > 0.02, "strong_up").when(rel > 0.005, "up").when(rel < -0.02, "strong_down")
                    .when(rel < -0.005, "down").otherwise("stable").alias("trend"))


def _last_k_mean(p: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    n = p.groupBy(*by).agg(F.max("t").alias("_tmax"))
    j = p.join(n, list(by)) if by else p.withColumn("_tmax", n.select("_tmax").scalar())
    return j.where(F.col("t") > F.col("_tmax") - k).groupBy(*by).agg(F.avg("y").alias(f"last{k}_mean"))


def linear_forecast(p: DataFrame, horizon: int = 6, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """L3 + L6: intercept + slope (n + i), blended 0.7 pred + 0.3 mean(last 3),
    floored at 0; interval ± z sigma_pop (1 + 0.1 i) with the low end floored."""
    f = _fit(p, by)
    f = f.join(_last_k_mean(p, by, 3), list(by)) if by else f.withColumn(
        "last3_mean", _last_k_mean(p, by, 3).select("last3_mean").scalar())
    h = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    raw = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    pred = F.greatest(F.lit(0.0), 0.7 * raw + 0.3 * F.col("last3_mean"))
    band = Z[level] * F.col("sd_pop") * (1 + 0.1 * F.col("step"))
    return h.select(*by, "step", pred.alias("forecast"), F.greatest(F.lit(0.0), pred - band).alias("lower"),
                    (pred + band).alias("upper"))


def exp_blend_forecast(p: DataFrame, horizon: int = 6, alpha: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """L4: linear predictions smoothed from the last value:
    s_i = max(0, alpha * lin_i + (1 - alpha) * s_{i-1}), s_0 = last; the floored value goes on."""
    f = _fit(p, by)
    lin = F.transform(F.sequence(F.lit(1), F.lit(horizon)),
                      lambda i: F.col("intercept") + F.col("slope") * (F.col("n") - 1 + i))
    sm = F.aggregate(lin, F.array().cast("array<double>"),
                     lambda acc, v: F.concat(acc, F.array(F.greatest(F.lit(0.0), alpha * v + (1 - alpha) * F.coalesce(
                         F.try_element_at(acc, F.lit(-1)), F.col("last"))))))
    out = f.select(*by, F.posexplode(sm).alias("pos", "v"))
    return out.select(*by, (F.col("pos") + 1).alias("step"), F.col("v").alias("forecast"))


def band_forecast(p: DataFrame, horizon: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Linear fit with a widening band ± 1.96 * 0.3 * i * sigma (sample)."""
    f = _fit(p, by)
    h = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    pred = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    band = 1.96 * 0.3 * F.col("step") * F.col("sd")
    return h.select(*by, "step", pred.alias("forecast"), (pred - band).alias("lower"), (pred + band).alias("upper"),
                    F.col("r2"))


def choose_model(p: DataFrame, by: Sequence[str] = (), seasonal: DataFrame | None = None) -> DataFrame:
    """>= 24 points and seasonal -> holt_winters, >= 10 -> linear, >= 3 -> drift, else naive."""
    f = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if seasonal is not None:
        f = f.join(seasonal, list(by), "left") if by else f.withColumn("seasonal", seasonal.select("seasonal").scalar())
    else:
        f = f.withColumn("seasonal", F.lit(False))
    s = F.coalesce(F.col("seasonal"), F.lit(False))
    return f.withColumn("method", F.when((F.col("n") >= 24) & s, "holt_winters").when(F.col("n") >= 10, "linear")
                        .when(F.col("n") >= 3, "drift").otherwise("naive"))


def _holt_winters(alpha: float, beta: float, gamma: float, horizon: int, by: list[str]):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(dtype=float)
        n = len(y)
        m = int(max(1, min(7, n // 2)))
        level, trend = y[0], (y[m] - y[0]) / m if n > m else 0.0
        season = (y[:m] - y[:m].mean()) if n >= m else np.zeros(m)
        season = list(season)
        for i in range(n):
            s = season[i % m]
            prev_level = level
            level = alpha * (y[i] - s) + (1 - alpha) * (level + trend)
            trend = beta * (level - prev_level) + (1 - beta) * trend
            season[i % m] = gamma * (y[i] - level) + (1 - gamma) * s
        steps = np.arange(1, horizon + 1)
        fc = [level + h * trend + season[(n + h - 1) % m] for h in steps]
        out = pd.DataFrame({"step": steps.astype("int32"), "forecast": fc})
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "step", "forecast"]]

    return fit


def holt_winters(p: DataFrame, by: Sequence[str], horizon: int = 7, alpha: float = 0.3, beta: float = 0.1,
                 gamma: float = 0.1) -> DataFrame:
    """Additive Holt-Winters, period min(7, n/2), fixed smoothing factors,
    one series per ``applyInPandas`` group (series are bounded by their time
    span; an unbounded raw series should be resampled first, D9)."""
    by = list(by)
    schema = ", ".join([f"{b} {p.schema[b].dataType.simpleString()}" for b in by] + ["step int", "forecast double"])
    return p.select(*by, "t", "y").groupBy(*by).applyInPandas(_holt_winters(alpha, beta, gamma, horizon, by), schema)


def decompose(p: DataFrame, period: int, by: Sequence[str] = ()) -> DataFrame:
    """Centred moving-average trend (window = period), seasonal mean of
    (y - trend) by position mod period, residual; missing trend -> series
    mean, missing seasonal -> 0."""
    by = list(by)
    half = period // 2
    r = p.select(*by, "t", "y", (F.col("t") + 1).alias("_rn"))
    # centred window: the trailing window sum ending ``half`` rows later
    shifted = win.window_sum(r.withColumn("_rn", F.col("_rn")), "y", period, rn="_rn") if not by else None
    if by:
        from pyspark.sql import Window
        w = Window.partitionBy(*by).orderBy("t").rowsBetween(-half, period - half - 1)
        r = r.withColumn("trend", F.when(F.count("y").over(w) == period, F.avg("y").over(w)))
    else:
        lead = shifted.select((F.col("_rn") - (period - half - 1)).alias("_rn"), (F.col("_wsum") / period).alias("trend"),
                              F.col("_rn").alias("_end"))
        r = r.join(lead, "_rn", "left").withColumn("trend", F.when(F.col("_end") >= period, F.col("trend"))).drop("_end")
    mean = r.groupBy(*by).agg(F.avg("y").alias("_mu"))
    r = r.join(mean, by) if by else r.withColumn("_mu", mean.select("_mu").scalar())
    r = r.withColumn("_pos", F.col("t") % period)
    seas = r.where(F.col("trend").isNotNull()).groupBy(*by, "_pos").agg(F.avg(F.col("y") - F.col("trend")).alias("seasonal"))
    out = r.join(seas, [*by, "_pos"], "left")
    trend = F.coalesce(F.col("trend"), F.col("_mu"))
    season = F.coalesce(F.col("seasonal"), F.lit(0.0))
    return out.select(*by, "t", "y", trend.alias("trend"), season.alias("seasonal"),
                      (F.col("y") - trend - season).alias("residual"))


def backtest(p: DataFrame, by: Sequence[str] = (), train: float = 0.8) -> DataFrame:
    """Fit on the first 80 % of positions, score the rest: RMSE, MAE,
    MAPE (non-zero actuals), R²."""
    by = list(by)
    n = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    j = p.join(n, by) if by else p.withColumn("_n", n.select("_n").scalar())
    cut = F.floor(F.col("_n") * train)
    tr = j.where(F.col("t") < cut)
    te = j.where(F.col("t") >= cut)
    f = tr.groupBy(*by).agg(F.regr_slope("y", F.col("t").cast("double")).alias("b"),
                            F.regr_intercept("y", F.col("t").cast("double")).alias("a"))
    s = te.join(f, by) if by else te.withColumn("a", f.select("a").scalar()).withColumn("b", f.select("b").scalar())
    err = F.col("y") - (F.col("a") + F.col("b") * F.col("t"))
    g = s.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                           (F.avg(F.when(F.col("y") != 0, F.abs(err / F.col("y")))) * 100).alias("mape"),
                           F.sum(err * err).alias("_sse"), F.var_pop("y").alias("_v"), F.count(F.lit(1)).alias("test_n"))
    return g.select(*by, "rmse", "mae", "mape", (1 - F.col("_sse") / (F.col("_v") * F.col("test_n"))).alias("r2"), "test_n")


def forecast_flags(fc: DataFrame, p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per forecast step: risk when forecast < 0.9 last or lower < 0.7
    forecast, opportunity when forecast > 1.15 last; the peak step flagged."""
    by = list(by)
    last = p.groupBy(*by).agg(F.max_by("y", "t").alias("last"))
    j = fc.join(last, by) if by else fc.withColumn("last", last.select("last").scalar())
    peak = j.groupBy(*by).agg(F.max("forecast").alias("_peak"))
    j = j.join(peak, by) if by else j.withColumn("_peak", peak.select("_peak").scalar())
    return j.select(*by, "step", "forecast", "last",
                    ((F.col("forecast") < 0.9 * F.col("last")) | (F.col("lower") < 0.7 * F.col("forecast"))).alias("risk"),
                    (F.col("forecast") > 1.15 * F.col("last")).alias("opportunity"),
                    (F.col("forecast") == F.col("_peak")).alias("peak"))


def sufficiency(p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """min(n / 30 * 50, 50) + 50 (1 - CV), CV = std_pop / |mean| capped to [0, 1]."""
    g = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    cv = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.abs(F.col("m"))))
    return g.select(*by, "n", (F.least(F.col("n") / 30.0 * 50, F.lit(50.0)) + 50 * (1 - cv)).alias("score"))


def sma_signal(p: DataFrame, window: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Last value vs its trailing SMA: > +5 % bullish, < -5 % bearish; the
    next five values extend the SMA by its mean step, (last SMA - first SMA) / number
    of SMA points.  A series shorter than two windows uses half its length; an SMA
    of 0 has deviation 0."""
    by = list(by)
    ends = p.groupBy(*by).agg(F.min("t").alias("_tmin"), F.max("t").alias("_tmax"))
    ends = ends.withColumn("_w", F.greatest(F.lit(1), F.least(F.lit(window), F.floor((F.col("_tmax") - F.col("_tmin") + 1) / 2))))
    j = p.join(ends, by) if by else p.withColumns({c: ends.select(c).scalar() for c in ("_tmin", "_tmax", "_w")})
    head, tail = F.col("t") < F.col("_tmin") + F.col("_w"), F.col("t") > F.col("_tmax") - F.col("_w")
    g = j.groupBy(*by).agg(F.avg(F.when(tail, F.col("y"))).alias("sma"), F.avg(F.when(head, F.col("y"))).alias("_first"),
                           F.max_by("y", "t").alias("last"),
                           F.max(F.col("_tmax") - F.col("_tmin") + 2 - F.col("_w")).alias("_points"))
    dev = F.when(F.col("sma") == 0, 0.0).otherwise(F.try_divide(F.col("last") - F.col("sma"), F.col("sma")) * 100)
    step = (F.col("sma") - F.col("_first")) / F.col("_points")
    return g.select(*by, "last", "sma", dev.alias("deviation_pct"),
                    F.when(dev > 5, "bullish").when(dev < -5, "bearish").otherwise("neutral").alias("signal"),
                    (F.col("sma") + step).alias("next_value"),
                    F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("sma") + step * i).alias("next_values"))


def quadratic_forecast(p: DataFrame, last_n: int = 30, horizon: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Degree-2 least squares on the last ``last_n`` points (x = 0..k-1),
    solved from power-sum aggregates by Cramer's rule; band ± 1.96 residual sigma."""
    by = list(by)
    tmax = p.groupBy(*by).agg(F.max("t").alias("_tmax"))
    j = p.join(tmax, by) if by else p.withColumn("_tmax", tmax.select("_tmax").scalar())
    first = F.greatest(F.col("_tmax") - last_n + 1, F.lit(0))  # a shorter series starts at its own first point
    w = j.where(F.col("t") > F.col("_tmax") - last_n).withColumn("x", (F.col("t") - first).cast("double"))
    x, y = F.col("x"), F.col("y")
    s = w.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("s0"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
                           F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"), F.sum(y).alias("t0"),
                           F.sum(x * y).alias("t1"), F.sum(x * x * y).alias("t2"))
    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det3(a, b, cc, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + cc * (d * h - e * g)
    D = det3(c["s0"], c["s1"], c["s2"], c["s1"], c["s2"], c["s3"], c["s2"], c["s3"], c["s4"])
    A = det3(c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"], c["s3"], c["s4"]) / D
    B = det3(c["s0"], c["t0"], c["s2"], c["s1"], c["t1"], c["s3"], c["s2"], c["t2"], c["s4"]) / D
    C = det3(c["s0"], c["s1"], c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"]) / D
    coef = s.select(*by, A.alias("a"), B.alias("b"), C.alias("c"), F.col("s0").alias("k"))
    res = w.join(coef, by) if by else w.withColumns({k: coef.select(k).scalar() for k in ("a", "b", "c", "k")})
    sig = res.groupBy(*by).agg(F.stddev_pop(F.col("y") - (F.col("a") + F.col("b") * x + F.col("c") * x * x)).alias("sigma"))
    coef = coef.join(sig, by) if by else coef.withColumn("sigma", sig.select("sigma").scalar())
    h = coef.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    xf = F.col("k") - 1 + F.col("step")
    pred = F.col("a") + F.col("b") * xf + F.col("c") * xf * xf
    return h.select(*by, "step", pred.alias("forecast"), (pred - 1.96 * F.col("sigma")).alias("lower"),
                    (pred + 1.96 * F.col("sigma")).alias("upper"))


def linear_with_error(p: DataFrame, horizon: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, R², s = sqrt(SSres / (n - 2)) and the next
    ``horizon`` predictions."""
    f = _fit(p, by)
    ssres = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    se = F.sqrt(ssres / (F.col("n") - 2))
    h = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return h.select(*by, "step", "slope", "intercept", "r2", se.alias("std_error"),
                    (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"))


def drift_forecast(p: DataFrame, horizon: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Last + i (last - first) / n."""
    f = p.groupBy(*by).agg(F.min_by("y", "t").alias("first"), F.max_by("y", "t").alias("last"),
                           F.count(F.lit(1)).alias("n"))
    h = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return h.select(*by, "step", (F.col("last") + F.col("step") * (F.col("last") - F.col("first")) / F.col("n")).alias("forecast"))

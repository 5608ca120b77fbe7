"""Data quality and repair.

Every check is one aggregate over the table (or one per numeric column group
after an unpivot); only per-column statistics reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import scalars
from kestrel.plans.distributed import distinct_counts, distinct_scalars, exact_quantiles, stats_scalar, top_k_per_group
from kestrel.session import checkpoint_dir

_GROUPS = {"numeric": T.NumericType, "string": T.StringType, "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
           "boolean": T.BooleanType}


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("kv")).select("kv.*")


def validate_schema(df: DataFrame, required: Sequence[str] = (), types: Mapping[str, str] | None = None) -> DataFrame:
    """(column, issue, severity) for missing required columns and columns
    outside their declared type group.  Only the schema is read."""
    rows = [(c, "missing_required_column", "error") for c in required if c not in df.columns]
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c, group in (types or {}).items():
        if c in fields and not isinstance(fields[c], _GROUPS[group]):
            rows.append((c, f"expected_{group}", "error"))
    return df.sparkSession.createDataFrame(rows, "column string, issue string, severity string")


def completeness(df: DataFrame, error_pct: float = 50.0, warn_pct: float = 20.0) -> DataFrame:
    """Null count and % per column; > 50 error, > 20 warning, else ok."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}")
                                                   for i, c in enumerate(df.columns)])
    long = row.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"))
                                                 for i, c in enumerate(df.columns)])).alias("kv")).select("__n", "kv.*")
    pct = F.col("null_count") * 100.0 / F.col("__n")
    return long.select("column", "null_count", pct.alias("null_pct"),
                       F.when(pct > error_pct, "error").when(pct > warn_pct, "warning").otherwise("ok").alias("level"))


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "id" in c.lower() or "key" in c.lower()]


def id_uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Duplicated values per id-like column (pandas ``duplicated``: later
    repeats, nulls equal to each other)."""
    cols = list(columns or id_columns(df))
    again = F.col("rows") - F.col("distinct") - (F.col("nulls") > 0).cast("long")
    return distinct_counts(df, cols).select("column", again.alias("duplicates"),
                                            F.try_divide(again * 100.0, F.col("rows")).alias("duplicate_pct"))


def _rule_violation(rule: Mapping) -> Column:
    c = F.col(rule["column"])
    kind = rule["type"]
    if kind == "not_null":
        return c.isNull()
    if kind == "range":
        cond = F.lit(False)
        if rule.get("min") is not None:
            cond = cond | (c < rule["min"])
        if rule.get("max") is not None:
            cond = cond | (c > rule["max"])
        return c.isNotNull() & cond
    if kind == "allowed":
        return c.isNotNull() & ~c.isin(list(rule["values"]))
    if kind == "regex":
        return c.isNotNull() & ~c.cast("string").rlike(rule["pattern"])
    raise ValueError(f"unknown rule type {kind}")


def rule_checks(df: DataFrame, rules: Sequence[Mapping], samples: int = 10) -> DataFrame:
    """I4: per rule the violation count and up to ``samples`` smallest distinct
    violating values (as strings).  One-sided ranges are supported."""
    flags = df.select(F.explode(F.array(*[
        F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["column"]).alias("column"),
                 _rule_violation(r).alias("bad"), F.col(r["column"]).cast("string").alias("value"))
        for r in rules])).alias("kv")).select("kv.*").where("bad")
    counts = flags.groupBy("rule", "column").agg(F.count(F.lit(1)).alias("violations"))
    vals = flags.groupBy("rule", "value").agg(F.lit(1).alias("_one"))
    top = top_k_per_group(vals, ["rule"], [F.asc_nulls_first("value")], samples)
    samp = top.groupBy("rule").agg(F.array_sort(F.collect_list(F.coalesce("value", F.lit("null")))).alias("samples"))
    base = df.sparkSession.createDataFrame([(r["name"], r["column"]) for r in rules], "rule string, column string")
    out = base.join(counts, ["rule", "column"], "left").join(samp, "rule", "left")
    return out.select("rule", "column", F.coalesce("violations", F.lit(0)).alias("violations"),
                      F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def quality_score(df: DataFrame, rules: Sequence[Mapping] = ()) -> DataFrame:
    """30 completeness + 20 id uniqueness + 30 consistency (30 - 5 per
    error - 2 per warning) + 20 validity (share of checks passed)."""
    n_cols = len(df.columns)
    comp = completeness(df)
    ids = id_columns(df)
    uniq = id_uniqueness(df, ids) if ids else None
    rc = rule_checks(df, rules) if rules else None
    parts = [comp.agg(F.sum("null_count").alias("nulls"), F.count_if(F.col("level") == "error").alias("e1"),
                      F.count_if(F.col("level") == "warning").alias("w1"), F.count_if(F.col("level") == "ok").alias("p1"))]
    s = stats_scalar(df.agg(F.count(F.lit(1)).alias("n")))
    res = parts[0].withColumn("n", s["n"])
    if uniq is not None:
        us = stats_scalar(uniq.agg(F.sum("duplicates").alias("dups"), F.count_if(F.col("duplicates") > 0).alias("w2"),
                                   F.count_if(F.col("duplicates") == 0).alias("p2")))
        res = res.withColumns({"dups": us["dups"], "w2": us["w2"], "p2": us["p2"]})
    else:
        res = res.withColumns({"dups": F.lit(0), "w2": F.lit(0), "p2": F.lit(0)})
    if rc is not None:
        rs = stats_scalar(rc.agg(F.count_if(F.col("violations") > 0).alias("e3"),
                                 F.count_if(F.col("violations") == 0).alias("p3")))
        res = res.withColumns({"e3": rs["e3"], "p3": rs["p3"]})
    else:
        res = res.withColumns({"e3": F.lit(0), "p3": F.lit(0)})
    checks = n_cols + len(ids) + len(rules)
    completeness_pts = (1 - F.col("nulls") / (F.col("n") * n_cols)) * 30
    uniq_pts = (1 - F.col("dups") / (F.col("n") * len(ids))) * 20 if ids else F.lit(20.0)
    errors = F.col("e1") + F.col("e3")
    warns = F.col("w1") + F.col("w2")
    consistency = F.greatest(F.lit(0.0), 30 - errors * 5 - warns * 2)
    validity = (F.col("p1") + F.col("p2") + F.col("p3")) / checks * 20
    return res.select(completeness_pts.alias("completeness"), uniq_pts.alias("uniqueness"),
                      consistency.cast("double").alias("consistency"), validity.alias("validity"),
                      (completeness_pts + uniq_pts + consistency + validity).alias("score"))


def quality_score_weighted(df: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 row uniqueness + 0.3 type consistency (the share of columns
    that ``type_consistency`` calls consistent); an empty table scores 0."""
    consistent = type_consistency(df).agg(F.avg(F.col("consistent").cast("double"))).scalar()
    n_cols = len(df.columns)
    a = df.agg(F.count(F.lit(1)).alias("n"),
               reduce(lambda x, y: x + y, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("nulls"),
               F.count_distinct(F.struct(*df.columns)).alias("distinct_rows"))
    full = F.col("n") > 0
    comp = F.when(full, 1 - F.try_divide(F.col("nulls"), F.col("n") * n_cols)).otherwise(0.0)
    uniq = F.when(full, F.try_divide(F.col("distinct_rows"), F.col("n"))).otherwise(0.0)
    cons = F.when(full, consistent).otherwise(0.0)
    return a.select(comp.alias("completeness"), uniq.alias("uniqueness"), cons.alias("consistency"),
                    (comp * 0.4 + uniq * 0.3 + cons * 0.3).alias("score"))


def type_consistency(df: DataFrame) -> DataFrame:
    """(column, kinds, consistent): how many kinds of value a column holds, a missing value
    being one; at most two are consistent.  Values of a text column are booleans, numbers, dates
    or other text, by the first that parses; a typed column has one kind beside the missing.
    One aggregate; an empty column has 0 kinds."""
    aggs, n_kinds = [], {}
    for i, f in enumerate(df.schema.fields):
        x = F.col(f"`{f.name}`")
        kind = F.when(x.isNull(), "missing")
        if isinstance(f.dataType, T.StringType):
            kind = (kind.when(scalars.parse_bool(x).isNotNull(), "boolean").when(scalars.clean_numeric(x).isNotNull(), "number")
                    .when(scalars.parse_mixed_date(x).isNotNull(), "date"))
        kind = kind.otherwise("value")
        names = ("missing", "boolean", "number", "date", "value")
        aggs += [F.coalesce(F.max((kind == k).cast("int")), F.lit(0)).alias(f"k{i}_{k}") for k in names]
        n_kinds[f.name] = reduce(lambda a, b: a + b, [F.col(f"k{i}_{k}") for k in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), n.alias("kinds")) for c, n in n_kinds.items()])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*", (F.col("r.kinds") <= 2).alias("consistent"))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, samples: int = 10) -> DataFrame:
    """Per numeric column Q1, Q3, fences at k·IQR, outlier count and %,
    and up to ``samples`` most extreme outliers (largest distance first)."""
    cols = list(columns or _numeric_cols(df))
    long = _long_numeric(df, cols).where(F.col("x").isNotNull())
    q = exact_quantiles(long, "x", [0.25, 0.75], by=["column"], names=["q1", "q3"])
    q = q.withColumn("lower", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "upper", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    j = long.join(F.broadcast(q), "column")  # one row per column: bounded
    bad = (F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))
    st = j.groupBy("column", "q1", "q3", "lower", "upper").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("outliers"))
    dist = F.greatest(F.col("lower") - F.col("x"), F.col("x") - F.col("upper"))
    ex = top_k_per_group(j.where(bad).select("column", "x", dist.alias("_d")), ["column"],
                         [F.desc("_d"), F.asc("x")], samples)
    ex = ex.groupBy("column").agg(F.array_sort(F.collect_list("x")).alias("samples"))
    return st.join(ex, "column", "left").withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n"))


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0,
                    population: bool = False) -> DataFrame:
    """Rows per column with |x - mean| / std > threshold (sample std by
    default, population std for the alert/profile variants)."""
    cols = list(columns or _numeric_cols(df))
    long = _long_numeric(df, cols).where(F.col("x").isNotNull())
    sd = F.stddev_pop("x") if population else F.stddev_samp("x")
    st = long.groupBy("column").agg(F.avg("x").alias("mean"), sd.alias("std"), F.count(F.lit(1)).alias("n"))
    j = long.join(F.broadcast(st), "column")
    z = F.abs(F.col("x") - F.col("mean")) / F.col("std")
    return j.groupBy("column", "mean", "std", "n").agg(F.count_if(z > threshold).alias("outliers")).withColumn(
        "outlier_pct", F.col("outliers") * 100.0 / F.col("n"))


def mad_outliers(df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
    """Modified z = 0.6745 (x - median) / MAD > threshold; when MAD = 0
    fall back to |z| > 3 with population std.  Severity by outlier %:
    > 10 high, > 5 medium, else low."""
    x = F.col(column).cast("double")
    base = df.where(x.isNotNull()).select(x.alias("x"))
    med = stats_scalar(exact_quantiles(base, "x", [0.5], names=["median"]))["median"]
    dev = base.select(F.abs(F.col("x") - med).alias("d"))
    mad = stats_scalar(exact_quantiles(dev, "d", [0.5], names=["mad"]))["mad"]
    mom = stats_scalar(base.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")))
    mz = F.lit(0.6745) * (F.col("x") - med) / mad
    z = (F.col("x") - mom["m"]) / mom["s"]
    flag = F.when(mad != 0, F.abs(mz) > threshold).otherwise(F.abs(z) > 3)
    out = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("outliers"))
    pct = F.col("outliers") * 100.0 / F.col("n")
    return out.select("n", "outliers", pct.alias("outlier_pct"), med.alias("median"), mad.alias("mad"),
                      F.when(pct > 10, "high").when(pct > 5, "medium").otherwise("low").alias("severity"))


def cap_outliers(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99,
                 max_pct: float = 10.0) -> DataFrame:
    """I16: clip a column to [p1, p99] when its share of rows outside that
    range is above 0 and below ``max_pct``; otherwise leave it."""
    bounds = _column_quantiles(df, columns, [lower, upper])
    if not bounds:
        return df
    outside = [F.avg(((F.col(c).cast("double") < lo) | (F.col(c).cast("double") > hi)).cast("double")).alias(c)
               for c, (lo, hi) in bounds.items()]
    share = df.agg(*outside).first()  # one row of shares
    return df.withColumns({c: F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo))
                           for c, (lo, hi) in bounds.items() if 0 < (share[c] or 0) * 100 < max_pct})


def _column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of numeric columns, all from one range scan; a row per column reaches the
    driver, none for a column without a value."""
    if not columns:
        return {}
    names = [f"q{i}" for i in range(len(probs))]
    q = exact_quantiles(_long_numeric(df, columns), "x", probs, by=["column"], names=names)
    return {r["column"]: [r[n] for n in names] for r in q.collect()}


def impute(df: DataFrame, strategies: Mapping[str, str], order: Sequence[str] | None = None,
           constants: Mapping[str, object] | None = None) -> DataFrame:
    """Per-column mean / median / mode / ffill / bfill / constant."""
    from kestrel.operators.aggregate import mode as mode_op
    from kestrel.operators.windows import fill
    out = df
    medians = _column_quantiles(df, [c for c, how in strategies.items() if how == "median"], [0.5])
    for c, how in strategies.items():
        if how == "mean":
            out = out.withColumn(c, F.coalesce(F.col(c), df.agg(F.avg(c)).scalar()))
        elif how == "median":
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(medians.get(c, [None])[0]).cast(df.schema[c].dataType)))
        elif how == "mode":
            m = mode_op(df, c).select("mode").scalar()
            out = out.withColumn(c, F.coalesce(F.col(c), m))
        elif how in ("ffill", "bfill"):
            out = fill(out, c, list(order or []), direction="forward" if how == "ffill" else "backward")
        elif how == "constant":
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit((constants or {}).get(c))))
    return out


def impute_plan(df: DataFrame, aggressive: bool = False, skip_pct: float = 50.0, drop_pct: float = 80.0) -> DataFrame:
    """(column, missing, missing_pct, strategy) of every column with missing values:
    numbers take the median, dates and times the last value before and then the first after,
    other columns the mode.  More than ``skip_pct`` missing: ``skip``; when ``aggressive``
    columns are filled up to ``drop_pct`` missing and ``drop``ped beyond."""
    by_type = F.lit("mode")
    for f in df.schema.fields:
        how = ("median" if isinstance(f.dataType, T.NumericType)
               else "ffill+bfill" if isinstance(f.dataType, _GROUPS["datetime"]) else None)
        by_type = F.when(F.col("column") == f.name, how).otherwise(by_type) if how else by_type
    far = F.col("null_pct") > (drop_pct if aggressive else skip_pct)
    return completeness(df).where(F.col("null_count") > 0).select(
        "column", F.col("null_count").alias("missing"), F.col("null_pct").alias("missing_pct"),
        F.when(far, "drop" if aggressive else "skip").otherwise(by_type).alias("strategy"))


def auto_impute(df: DataFrame, skip_pct: float = 50.0, order: Sequence[str] | None = None, aggressive: bool = False) -> DataFrame:
    """Fill by ``impute_plan``.  Dates are filled in ``order`` (unique; a table has no
    order of its own), without one they are left alone; what an all-null column lacks stays null."""
    plan = {r["column"]: r["strategy"] for r in impute_plan(df, aggressive, skip_pct).collect()}  # one row per column
    out = impute(df, {c: how for c, how in plan.items() if how in ("median", "mode")})
    for c, how in plan.items():
        if how == "ffill+bfill" and order:
            out = impute(impute(out, {c: "ffill"}, order), {c: "bfill"}, order)
    return out.drop(*[c for c, how in plan.items() if how == "drop"])


def replace_inf_drop_constant(df: DataFrame) -> DataFrame:
    """±inf -> column median; constant columns dropped."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    endless = {c: F.col(c).isin(float("inf"), float("-inf")) for c in cols}
    medians = _column_quantiles(df.select(*[F.when(~e, F.col(c)).alias(c) for c, e in endless.items()]), cols, [0.5])
    out = df.withColumns({c: F.when(e, F.lit(medians.get(c, [None])[0])).otherwise(F.col(c)) for c, e in endless.items()})
    found = distinct_counts(df, df.columns).where(F.col("distinct") <= 1).collect()  # one row per column
    return out.drop(*[r["column"] for r in found])


def type_repair(df: DataFrame, numeric_share: float = 0.8, date_share: float = 0.7, unit_share: float = 0.6) -> DataFrame:
    """String columns become double when > 80 % of non-null values parse, or > 60 % parse
    as numbers with a unit (``12k``, ``3.5M``, ``80%``),
    timestamp when > 70 % parse and the name hints at a date, boolean when all
    values are in the yes/no sets.  Shares come from one aggregate."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    aggs = []
    for c in strs:
        nn = F.col(c).isNotNull()
        aggs += [F.avg(F.when(nn, scalars.clean_numeric(F.col(c)).isNotNull().cast("double"))).alias(f"num_{c}"),
                 F.avg(F.when(nn, scalars.parse_mixed_date(F.col(c)).isNotNull().cast("double"))).alias(f"dt_{c}"),
                 F.avg(F.when(nn, scalars.parse_bool(F.col(c)).isNotNull().cast("double"))).alias(f"b_{c}"),
                 F.avg(F.when(nn, scalars.parse_units(F.col(c)).isNotNull().cast("double"))).alias(f"u_{c}")]
    row = df.agg(*aggs).first()
    conv = {}
    for c in strs:
        hint = any(h in c.lower() for h in ("date", "time", "day", "month", "year", "created", "updated"))
        if (row[f"b_{c}"] or 0) == 1.0:
            conv[c] = scalars.parse_bool(F.col(c))
        elif (row[f"num_{c}"] or 0) > numeric_share:
            conv[c] = scalars.clean_numeric(F.col(c))
        elif hint and (row[f"dt_{c}"] or 0) > date_share:
            conv[c] = scalars.parse_mixed_date(F.col(c))
        elif (row[f"u_{c}"] or 0) > unit_share:
            conv[c] = scalars.parse_units(F.col(c))
    return df.withColumns(conv)


def issue_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Tidy issue rows (column, issue, severity, value) — missing > 10/30/50 %,
    duplicate rows > 5/20 %, IQR outliers > 10 %, string cardinality > 100,
    constant columns, id-like (> 95 % distinct), numbers stored as text
    (> 90 % parse), class imbalance of ``target`` (> 3/5/10)."""
    n_cols = df.columns
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("__n"), F.count_distinct(F.struct(*df.columns)).alias("__dr")]
    for i, c in enumerate(n_cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"m{i}"))
    for i, c in enumerate(strs):
        aggs.append(F.avg(F.when(F.col(c).isNotNull(), scalars.clean_numeric(F.col(c)).isNotNull().cast("double")))
                    .alias(f"s{i}"))
    row = df.agg(*aggs).withColumns({f"d{i}": d for i, d in enumerate(distinct_scalars(df, n_cols))})
    items = []
    for i, c in enumerate(n_cols):
        miss = F.col(f"m{i}") * 100.0 / F.col("__n")
        items.append(F.struct(F.lit(c).alias("column"), F.lit("missing").alias("issue"),
                              F.when(miss > 50, "critical").when(miss > 30, "high").when(miss > 10, "medium").alias("severity"),
                              miss.alias("value")))
        items.append(F.struct(F.lit(c).alias("column"), F.lit("constant").alias("issue"),
                              F.when(F.col(f"d{i}") <= 1, "medium").alias("severity"), F.col(f"d{i}").cast("double").alias("value")))
        share = F.col(f"d{i}") * 100.0 / F.col("__n")
        items.append(F.struct(F.lit(c).alias("column"), F.lit("id_like").alias("issue"),
                              F.when((share > 95) & (F.col("__n") > 1), "low").alias("severity"), share.alias("value")))
        if c in strs:
            items.append(F.struct(F.lit(c).alias("column"), F.lit("high_cardinality").alias("issue"),
                                  F.when(F.col(f"d{i}") > 100, "low").alias("severity"), F.col(f"d{i}").cast("double").alias("value")))
            j = strs.index(c)
            items.append(F.struct(F.lit(c).alias("column"), F.lit("numeric_as_string").alias("issue"),
                                  F.when(F.col(f"s{j}") > 0.9, "medium").alias("severity"), (F.col(f"s{j}") * 100).alias("value")))
    dup = (F.col("__n") - F.col("__dr")) * 100.0 / F.col("__n")
    items.append(F.struct(F.lit("*").alias("column"), F.lit("duplicate_rows").alias("issue"),
                          F.when(dup > 20, "high").when(dup > 5, "medium").alias("severity"), dup.alias("value")))
    rows = row.select(F.explode(F.array(*items)).alias("it")).select("it.*")
    nums = _numeric_cols(df)
    if nums:
        out = iqr_outliers(df, nums).select("column", F.lit("outliers").alias("issue"),
                                            F.when(F.col("outlier_pct") > 10, "medium").alias("severity"),
                                            F.col("outlier_pct").alias("value"))
        rows = rows.unionByName(out)
    if target:
        cnt = df.where(F.col(target).isNotNull()).groupBy(target).count().agg(
            (F.max("count") / F.min("count")).alias("ratio"))
        rows = rows.unionByName(cnt.select(F.lit(target).alias("column"), F.lit("imbalance").alias("issue"),
                                           F.when(F.col("ratio") > 10, "high").when(F.col("ratio") > 5, "medium")
                                           .when(F.col("ratio") > 3, "low").alias("severity"), F.col("ratio").alias("value")))
    return rows.where(F.col("severity").isNotNull())


def issue_score(issues: DataFrame) -> DataFrame:
    """I7 score: 100 - 20 critical - 10 high - 5 medium - 2 low (floored at 0)
    and grade A (>= 90), B (>= 80), C (>= 70), D (>= 60), else F."""
    pen = issues.agg(F.sum(F.when(F.col("severity") == "critical", 20).when(F.col("severity") == "high", 10)
                           .when(F.col("severity") == "medium", 5).otherwise(2)).alias("penalty"))
    score = F.greatest(F.lit(0), 100 - F.coalesce(F.col("penalty"), F.lit(0)))
    return pen.select(score.cast("double").alias("score"), F.when(score >= 90, "A").when(score >= 80, "B")
                      .when(score >= 70, "C").when(score >= 60, "D").otherwise("F").alias("grade"))


def detect_issues(df: DataFrame, missing_pct: float = 5.0, outlier_pct: float = 1.0) -> DataFrame:
    """I8: missing > 5 %, any duplicate rows, IQR outliers > 1 % per column."""
    comp = completeness(df).where(F.col("null_pct") > missing_pct).select(
        "column", F.lit("missing").alias("issue"), F.col("null_pct").alias("value"))
    dups = df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*df.columns))).cast("double").alias("value")).where(
        F.col("value") > 0).select(F.lit("*").alias("column"), F.lit("duplicates").alias("issue"), "value")
    nums = _numeric_cols(df)
    parts = [comp, dups]
    if nums:
        parts.append(iqr_outliers(df, nums).where(F.col("outlier_pct") > outlier_pct).select(
            "column", F.lit("outliers").alias("issue"), F.col("outlier_pct").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def enrich(df: DataFrame) -> DataFrame:
    """Year, month, day of the week (Monday 0) and weekend flag of every date or time
    column, named after it without ``_date`` / ``date_``, and ``total_value`` = price x
    quantity where numeric columns are named so.  Names that exist are left as they are."""
    have, new = set(df.columns), {}
    for f in df.schema.fields:
        if isinstance(f.dataType, _GROUPS["datetime"]):
            base, x = f.name.replace("_date", "").replace("date_", "").replace("Date", ""), F.col(f"`{f.name}`")
            new |= {f"{base}_year": F.year(x), f"{base}_month": F.month(x), f"{base}_day_of_week": F.weekday(x),
                    f"{base}_is_weekend": F.weekday(x) >= 5}
    nums = {c.lower(): c for c in _numeric_cols(df)}
    if "price" in nums and "quantity" in nums:
        new["total_value"] = F.col(f"`{nums['price']}`") * F.col(f"`{nums['quantity']}`")
    return df.withColumns({c: x for c, x in new.items() if c not in have})


FIX_LOG = "step string, column string, rows long, detail string"


def auto_fix(df: DataFrame, order: Sequence[str] | None = None, aggressive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Duplicates -> types -> missing -> outliers -> enrichment, with a log (step, column,
    rows it touched, detail) and the weighted quality score before and after.  The log has a row
    per column a step changed, so it is bounded by the columns.  Rows without their duplicates
    and the filled rows are checkpointed, as several later steps read them."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    log = []
    before, n = quality_score_weighted(df).select("score").first()[0], df.count()
    step = df.dropDuplicates().checkpoint()
    removed = n - step.count()
    if removed:
        log.append(("dedupe", "*", removed, "repeated rows removed"))
    typed = type_repair(step)
    log += [("types", f.name, n - removed, f"{step.schema[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
            for f in typed.schema.fields if f.dataType != step.schema[f.name].dataType]
    log += [("missing", r["column"], r["missing"], r["strategy"]) for r in impute_plan(typed, aggressive).collect()
            if r["strategy"] != "ffill+bfill" or order]
    step = auto_impute(typed, order=order, aggressive=aggressive).checkpoint()
    nums = [f.name for f in step.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    capped = cap_outliers(step, nums) if nums else step
    step = enrich(capped)
    log += [("enrich", c, n - removed, "derived") for c in step.columns if c not in capped.columns]
    after = quality_score_weighted(step).select("score").first()[0]
    log.append(("score", "*", n - removed, f"{before:.4f} -> {after:.4f}"))
    return step, spark.createDataFrame(log, FIX_LOG)

"""Profiling and schema inference.

Evidence is gathered in one aggregate per table (null counts, distinct
counts, parse shares, name hints) and turned into one row per column; the
small rule tables that pick roles run on that evidence, not on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import scalars
from kestrel.plans.distributed import column_counts, distinct_scalars, top_k_per_group, written

# Fixed name hints for role detection (keyword lists by role).
ROLE_HINTS = {
    "amount": ["amount", "revenue", "sales", "price", "total", "value", "cost", "profit", "income"],
    "date": ["date", "time", "day", "month", "year", "created", "timestamp"],
    "entity": ["customer", "client", "user", "name", "vendor", "supplier", "account"],
    "product": ["product", "item", "sku", "part", "brand"],
    "category": ["category", "type", "segment", "class", "group", "status", "priority", "region", "flag"],
    "id": ["id", "key", "code", "uuid", "number"],
    "quantity": ["qty", "quantity", "units", "count"],
}


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "string"


def infer_schema(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per column dtype, null count, distinct count, ``samples`` smallest
    distinct values (as text) and min / max / mean for numeric columns."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        num = isinstance(f.dataType, T.NumericType)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"),
                 (F.min(c).cast("double") if num else F.lit(None).cast("double")).alias(f"lo{i}"),
                 (F.max(c).cast("double") if num else F.lit(None).cast("double")).alias(f"hi{i}"),
                 (F.avg(c) if num else F.lit(None).cast("double")).alias(f"mu{i}")]
    row = df.agg(*aggs).withColumns({f"d{i}": d for i, d in enumerate(distinct_scalars(df, df.columns))})
    long = row.select("__n", F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
        F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"lo{i}").alias("min"),
        F.col(f"hi{i}").alias("max"), F.col(f"mu{i}").alias("mean")) for i, f in enumerate(fields)])).alias("s")).select(
        F.col("__n").alias("rows"), "s.*")
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("v"))
                                         for f in fields])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
    firsts = top_k_per_group(vals.distinct(), ["column"], [F.asc("v")], samples)
    firsts = firsts.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("samples"))
    return long.join(firsts, "column", "left")


def column_roles(df: DataFrame) -> DataFrame:
    """Column type (numeric / datetime / identifier / categorical / text)
    and role (amount, date, entity, product, category, id, quantity, other)
    from evidence: type, name hints, distinct ratio (> 0.9 identifier,
    <= 50 values or ratio < 0.3 categorical) and parse shares of strings
    (> 70 % number or date)."""
    fields = df.schema.fields
    texts = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    v, n = F.col("value"), F.col("n")
    here = F.col("position").isin(texts) & v.isNotNull()  # each differing text is looked at once
    found = column_counts(
        df, df.columns, num_share=F.sum(F.when(here, F.when(scalars.clean_numeric(v).isNotNull(), n).otherwise(0))),
        date_share=F.sum(F.when(here, F.when(scalars.parse_mixed_date(v).isNotNull(), n).otherwise(0))),
        avg_len=F.sum(F.when(here, F.length(v) * n)))
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f.name, _kind(f.dataType))])
    present = F.col("rows") - F.col("nulls")
    long = found.select("rows", "column", kinds[F.col("column")].alias("kind"), "distinct",
                        *[F.try_divide(c, present).alias(c) for c in ("num_share", "date_share", "avg_len")])
    ratio = F.col("distinct") / F.col("rows")
    lname = F.lower(F.col("column"))

    def hint(role):
        # a hint of two letters has to be a word of the name: id is not meant by paid or width
        return reduce(lambda a, b: a | b, [lname.contains(k) if len(k) > 2 else lname.rlike(rf"(^|[^a-z0-9]){k}([^a-z0-9]|$)")
                                           for k in ROLE_HINTS[role]])

    ctype = (F.when((F.col("kind") == "numeric") | (F.col("num_share") > 0.7), "numeric")
             .when((F.col("kind") == "datetime") | (F.col("date_share") > 0.7), "datetime")
             .when(hint("id") & (ratio > 0.9), "identifier")
             .when((F.col("distinct") <= 50) | (ratio < 0.3), "categorical")
             .when(F.col("avg_len") > 50, "text").otherwise("identifier"))
    role = (F.when(ctype == "datetime", "date")
            .when(hint("id") & (ratio > 0.9), "id")
            .when((ctype == "numeric") & hint("quantity"), "quantity")
            .when((ctype == "numeric") & hint("amount"), "amount")
            .when(hint("product"), "product").when(hint("entity"), "entity")
            .when(ctype == "categorical", "category").when(ctype == "numeric", "measure").otherwise("other"))
    return long.withColumn("distinct_ratio", ratio).withColumn("column_type", ctype).withColumn("role", role)


def best_columns(roles: DataFrame, df: DataFrame) -> DataFrame:
    """The best amount column (largest absolute sum) and best date column
    (most non-null values), one row each."""
    best = {r["column"]: r["role"] for r in roles.where(F.col("role").isin("amount", "date")).select("column", "role").collect()}
    if not best:
        return df.sparkSession.createDataFrame([], "role string, column string, score double")
    one = df.agg(*[(F.sum(F.abs(F.col(c).cast("double"))) if r == "amount" else F.count(c).cast("double")).alias(c)
                   for c, r in best.items()])
    named = F.create_map(*[F.lit(x) for item in best.items() for x in item])
    u = one.unpivot([], list(best), "column", "score").withColumn("role", named[F.col("column")])
    w = Window.partitionBy("role").orderBy(F.desc("score"), F.asc("column"))  # rows = columns
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("role", "column", "score")


def metric_dimension_ranking(df: DataFrame, max_dim_ratio: float = 0.5) -> DataFrame:
    """Metrics ranked by importance = type bonus (10 for amount-like names)
    + min(20, |total| / 1e6) + completeness x 20; dimensions are string
    columns with distinct / rows <= 0.5, ranked by completeness then fewer values."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # numbers in one aggregate, texts in one count of their values, and both from one table
    df = written(df.select(*nums, *strs), "ranking")
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(F.abs(F.col(c).cast("double"))).alias(f"t_{c}") for c in nums]
    aggs += [F.count(F.col(c)).alias(f"c_{c}") for c in nums + strs]
    row = df.agg(*aggs).withColumns({f"d_{c}": d for c, d in zip(strs, distinct_scalars(df, strs))})
    items = []
    for c in nums:
        bonus = 10.0 if any(k in c.lower() for k in ROLE_HINTS["amount"]) else 0.0
        imp = F.lit(bonus) + F.least(F.lit(20.0), F.col(f"t_{c}") / 1e6) + F.col(f"c_{c}") / F.col("__n") * 20
        items.append(F.struct(F.lit(c).alias("column"), F.lit("metric").alias("kind"), imp.alias("importance")))
    for c in strs:
        ok = F.col(f"d_{c}") / F.col("__n") <= max_dim_ratio
        imp = F.when(ok, F.col(f"c_{c}") / F.col("__n") * 20 - F.col(f"d_{c}") / F.col("__n"))
        items.append(F.struct(F.lit(c).alias("column"), F.lit("dimension").alias("kind"), imp.alias("importance")))
    out = row.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(F.col("importance").isNotNull())
    w = Window.partitionBy("kind").orderBy(F.desc("importance"), F.asc("column"))  # rows = columns
    return out.withColumn("rank", F.row_number().over(w))


def cooccurrence(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """For each pair of the categorical columns the ``top``
    most frequent value pairs."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                                  F.col(a).cast("string").alias("value_a"),
                                                  F.col(b).cast("string").alias("value_b")) for a, b in pairs])).alias("p")).select("p.*")
    counts = long.where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()).groupBy(
        "col_a", "col_b", "value_a", "value_b").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(counts, ["col_a", "col_b"], [F.desc("count"), F.asc("value_a"), F.asc("value_b")], top,
                           out="rank")


def detect_target_and_task(df: DataFrame, target: str | None = None) -> DataFrame:
    """target = given, else the first column named like a target
    (target, label, class, churn, outcome, y), else the last column; task =
    classification for strings, booleans or integer columns with <= 20 values,
    else regression.  One aggregate for the target's evidence."""
    names = ["target", "label", "class", "churn", "outcome", "y"]
    if target is None:
        target = next((c for c in df.columns if c.lower() in names), df.columns[-1])
    f = df.schema[target]
    is_int = isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    ev = df.agg(F.count_distinct(target).alias("distinct"), F.count(target).alias("non_null"))
    kind = _kind(f.dataType)
    task = (F.when(F.lit(kind in ("string", "boolean")), "classification")
            .when(F.lit(is_int) & (F.col("distinct") <= 20), "classification").otherwise("regression"))
    return ev.select(F.lit(target).alias("target"), F.lit(kind).alias("kind"), "distinct", "non_null", task.alias("task"))


def feature_metadata(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Numeric features -> min / max / mean; categorical -> top 10 options."""
    nums = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    cats = [c for c in columns if c not in nums]
    parts = []
    if nums:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                             for c in nums])).alias("kv")).select("kv.*")
        parts.append(long.groupBy("feature").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
                                                 F.lit(None).cast("array<string>").alias("options")))
    if cats:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v"))
                                             for c in cats])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
        cnt = long.groupBy("feature", "v").count()
        topv = top_k_per_group(cnt, ["feature"], [F.desc("count"), F.asc("v")], top)
        parts.append(topv.groupBy("feature").agg(F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                                                 F.lit(None).cast("double").alias("mean"),
                                                 F.array_sort(F.collect_list("v")).alias("options")))
    return reduce(DataFrame.unionByName, parts)


def deep_profile(df: DataFrame, value: str, order: Sequence[str], category: str | None = None) -> DataFrame:
    """Ranked insights on one measure: temporal trend (|corr(position, x)|
    > 0.5), spikes / drops beyond ±2 sigma, top-3 category concentration > 50 %,
    CV > 0.5, |z| > 3 outliers (population sigma).  Tidy rows
    (insight, value, triggered)."""
    from kestrel.operators.windows import ranked
    r = ranked(df, order)
    x = F.col(value).cast("double")
    st = r.agg(F.corr(F.col("_rn").cast("double"), x).alias("trend_r"), F.avg(x).alias("mean"),
               F.stddev_pop(x).alias("sd_pop"), F.stddev_samp(x).alias("sd"))
    s = st.select(F.struct("*").alias("s")).scalar()
    counts = r.agg(F.count_if(x > s["mean"] + 2 * s["sd"]).alias("spikes"),
                   F.count_if(x < s["mean"] - 2 * s["sd"]).alias("drops"),
                   F.count_if(F.abs(x - s["mean"]) / s["sd_pop"] > 3).alias("z_outliers"))
    items = [("trend", F.abs(s["trend_r"]), F.abs(s["trend_r"]) > 0.5),
             ("cv", s["sd"] / F.abs(s["mean"]), s["sd"] / F.abs(s["mean"]) > 0.5)]
    rows = st.select(F.explode(F.array(*[F.struct(F.lit(n).alias("insight"), v.cast("double").alias("value"),
                                                  t.alias("triggered")) for n, v, t in items])).alias("i")).select("i.*")
    rows = rows.unionByName(counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("insight"), F.col(n).cast("double").alias("value"), (F.col(n) > 0).alias("triggered"))
        for n in ("spikes", "drops", "z_outliers")])).alias("i")).select("i.*"))
    if category:
        tot = df.groupBy(category).agg(F.sum(value).alias("t"))
        top3 = tot.orderBy(F.desc("t"), F.asc(category)).limit(3).agg(F.sum("t").alias("t3"))
        share = top3.select((F.col("t3") / tot.agg(F.sum("t")).scalar() * 100).alias("v"))
        rows = rows.unionByName(share.select(F.lit("top3_concentration").alias("insight"), F.col("v").alias("value"),
                                             (F.col("v") > 50).alias("triggered")))
    return rows

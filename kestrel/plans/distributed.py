"""Scale primitives for order-dependent work.

A window without ``partitionBy`` moves every row into one task.  The reference's
positional operators (cumulative shares, ranks over all entities, exact
quantiles, n//4 period splits) are therefore built here on a range-partitioned
scan instead:

1. ``repartitionByRange`` on the order keys (Spark samples the keys and splits
   even hot keys across tasks because the tie-breakers are part of the key),
2. ``sortWithinPartitions`` and a per-task position (and, when asked, a
   per-task running sum),
3. the result is ``checkpoint()``-ed into the shared checkpoint folder, so the
   task positions are data, not a recomputation that could pick other range
   bounds after an executor loss,
4. per-task totals (one row per task, a proven bound) are prefix-summed and
   broadcast back.

Callers must pass a *unique* order (add tie-breakers) when positions matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import checkpoint_dir, scratch_path

_LOC_BITS = 33  # monotonically_increasing_id = (partition << 33) + position


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what reads it several times: the joins before it
    run once, later reads take only the columns they need, and a lost executor re-reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _n_parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _local_running(values: list[str], kinds: dict[str, str], groups: list[str]):
    """mapInPandas body: per-task running sums (or maxima), carried across
    Arrow batches of the same task; with ``groups`` the sums restart at every
    group change (rows arrive sorted by group first)."""

    def run(batches):
        carry: dict[str, float | None] = {v: None for v in values}
        last_key = None
        for pdf in batches:
            if groups and len(pdf):
                gid = (pdf[groups].ne(pdf[groups].shift()).any(axis=1)).cumsum()
                first_key = tuple(pdf[groups].iloc[0].tolist())
                continues = last_key is not None and first_key == last_key
                if not continues:
                    gid = gid + 1  # the first group of the batch is new
            for v in values:
                x = pdf[v].astype("float64")
                mx = kinds.get(v, "sum") == "max"
                if groups and len(pdf):
                    if mx:
                        cs = x.groupby(gid.values).cummax()
                    else:
                        cs = x.fillna(0.0).groupby(gid.values).cumsum()
                    if continues and carry[v] is not None:
                        m = (gid == gid.iloc[0]).values
                        cs[m] = (cs[m].fillna(carry[v]).clip(lower=carry[v]) if mx else cs[m] + carry[v])
                elif mx:
                    cs = x.cummax()
                    if carry[v] is not None:
                        cs = cs.fillna(carry[v]).clip(lower=carry[v])
                else:
                    cs = x.fillna(0.0).cumsum() + (carry[v] or 0.0)
                if len(cs) and not pd.isna(cs.iloc[-1]):
                    carry[v] = float(cs.iloc[-1])
                elif len(cs) and groups:
                    carry[v] = None
                pdf["_cum_" + v] = cs
            if groups and len(pdf):
                last_key = tuple(pdf[groups].iloc[-1].tolist())
            yield pdf

    return run


def range_scan(df: DataFrame, order: Sequence[str | Column], running: Sequence[str] = (),
               partitions: int | None = None, kinds: dict[str, str] | None = None,
               groups: Sequence[str] = ()) -> DataFrame:
    """Range-partition + sort + per-task position/running sums, checkpointed.

    Returns ``df`` plus ``_pid`` (task), ``_loc`` (0-based position in task) and
    ``_cum_<v>`` for every column in ``running``.
    """
    checkpoint_dir(df.sparkSession)
    cols = _as_cols(order)
    ranged = df.repartitionByRange(_n_parts(df, partitions), *cols).sortWithinPartitions(*cols)
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _LOC_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND((1 << _LOC_BITS) - 1)).drop("_mid")
    if running:
        schema = T.StructType(ranged.schema.fields + [
            T.StructField("_cum_" + v, T.DoubleType()) for v in running])
        ranged = ranged.mapInPandas(_local_running(list(running), kinds or {}, list(groups)), schema)
    return ranged.checkpoint(eager=True)


def _offsets(scan: DataFrame, running: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for v in running:
        if kinds.get(v, "sum") == "max":
            aggs.append(F.max(v).cast("double").alias("_tot_" + v))
        else:
            aggs.append(F.coalesce(F.sum(v), F.lit(0.0)).cast("double").alias("_tot_" + v))
    per_task = scan.groupBy("_pid").agg(*aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    out = per_task.withColumn("_off_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    for v in running:
        if kinds.get(v, "sum") == "max":
            out = out.withColumn("_off_" + v, F.max("_tot_" + v).over(before))
        else:
            out = out.withColumn("_off_" + v, F.coalesce(F.sum("_tot_" + v).over(before), F.lit(0.0)))
    return out.drop("_n", *["_tot_" + v for v in running])


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rn",
                running: dict[str, str] | None = None, partitions: int | None = None,
                kinds: dict[str, str] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row in ``order`` over the whole table.

    ``running`` maps value column -> output column for running sums (rows
    unbounded preceding .. current row) in the same order; ``kinds`` may mark
    a value column ``"max"`` for a running maximum.  With ``groups`` (which
    must lead ``order``) the running values restart for every group: a group
    split over several tasks gets the totals of its earlier tasks from a table
    with at most one row per task (a proven bound, broadcast).
    """
    running = running or {}
    kinds = kinds or {}
    groups = list(groups)
    scan = range_scan(df, order, list(running), partitions, kinds, groups)
    # one row per task: a proven bound, so broadcasting it is safe
    offs = F.broadcast(_offsets(scan, [] if groups else list(running), kinds))
    res = scan.join(offs, "_pid").withColumn(out, F.col("_off_n") + F.col("_loc") + 1)
    if groups and running:
        aggs = [(F.max if kinds.get(v, "sum") == "max" else F.sum)(v).cast("double").alias("_t_" + v) for v in running]
        per = scan.groupBy("_pid", *groups).agg(*aggs)
        w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select("_pid", *[F.col(g).alias("_k_" + g) for g in groups],
                             F.count(F.lit(1)).over(w).alias("_prev"),
                             *[(F.max if kinds.get(v, "sum") == "max" else F.sum)("_t_" + v).over(w).alias("_off_" + v)
                               for v in running])
        carried = F.broadcast(carried.where(F.col("_prev") > 0).drop("_prev"))  # <= one row per task
        cond = F.col("_pid") == F.col("_c_pid")
        for g in groups:
            cond = cond & F.col(g).eqNullSafe(F.col("_k_" + g))
        res = res.join(carried.withColumnRenamed("_pid", "_c_pid"), cond, "left").drop(
            "_c_pid", *["_k_" + g for g in groups])
    for v, name in running.items():
        if kinds.get(v, "sum") == "max":
            res = res.withColumn(name, F.greatest(F.col("_off_" + v), F.col("_cum_" + v)))
        elif groups:
            res = res.withColumn(name, F.coalesce(F.col("_off_" + v), F.lit(0.0)) + F.col("_cum_" + v))
        else:
            res = res.withColumn(name, F.col("_off_" + v) + F.col("_cum_" + v))
    drop = ["_pid", "_loc", "_off_n"] + [f"_off_{v}" for v in running] + [f"_cum_{v}" for v in running]
    return res.drop(*drop)


def global_running_sum(df: DataFrame, value: str, order: Sequence[str | Column],
                       out: str = "running_sum", partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order`` (unique order)."""
    return global_rank(df, order, out="_rn_tmp", running={value: out}, partitions=partitions).drop("_rn_tmp")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``quantile`` / DuckDB
    ``quantile_cont``) of ``value`` per group ``by``, without holding a group or
    a frequent value in one task: rows are first counted per (group, value), a
    partial aggregate; the counts, one row per distinct value, get running sums
    on the range scan; the value whose run covers a target position is picked by
    a second partial aggregate.

    Returns one row per group with one column per probability (``names``).
    """
    names = list(names or [f"p{int(round(p * 100)):02d}" for p in probs])
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counts = base.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    runs = global_rank(counts, [*by, "_x"], out="_r", running={"_c": "_to"}).drop("_r")
    runs = runs.withColumn("_from", F.col("_to") - F.col("_c"))
    groups = runs.groupBy(*by).agg(F.min("_from").alias("_start"), F.sum("_c").alias("_cnt"))
    if by:
        groups = groups.withColumnsRenamed({c: "_g_" + c for c in by})
        cond = None
        for c in by:
            same = F.col(c).eqNullSafe(F.col("_g_" + c))
            cond = same if cond is None else cond & same
        runs = runs.join(groups, cond).drop(*["_g_" + c for c in by])
    else:
        runs = runs.withColumns({c: groups.select(c).scalar() for c in ("_start", "_cnt")})
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_cnt") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_from") - F.col("_start") <= place) & (place < F.col("_to") - F.col("_start"))
            picks.append(F.max(F.when(inside, F.col("_x"))).alias(f"_{end}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_part{i}"))
    found = runs.groupBy(*by).agg(*picks)
    return found.select(*by, *[(F.col(f"_lo{i}") + F.col(f"_part{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n)
                               for i, n in enumerate(names)])


def carry_last(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, out: str,
               partitions: int | None = None) -> DataFrame:
    """``out``: the last non-null ``value`` at or before each row, in ``order`` (unique) within ``by``.

    A group may spread over any number of tasks of the range scan.  Inside one task the value
    comes from a window over (task, group); what earlier tasks hand on is a table of at most one
    row per task (only a task's first group can have begun before it), which is broadcast.  Null
    keys form a group of their own; rows before the first value have null.
    """
    by = list(by)
    scan = range_scan(df, [*by, *order], partitions=partitions)
    inside = Window.partitionBy("_pid", *by).orderBy("_loc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = scan.groupBy("_pid", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_loc"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    handed = per.select(F.col("_pid").alias("_c_pid"), *[F.col(b).alias("_k_" + b) for b in by],
                        F.last("_last", ignorenulls=True).over(before).alias("_before")).where(F.col("_before").isNotNull())
    cond = F.col("_pid") == F.col("_c_pid")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col("_k_" + b))
    here = scan.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    res = here.join(F.broadcast(handed), cond, "left")  # <= one row per task
    return res.withColumn(out, F.coalesce("_here", "_before")).drop(
        "_pid", "_loc", "_here", "_before", "_c_pid", *["_k_" + b for b in by])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, value as text, n): how often each value, null among them, stands in each of ``columns``.

    The table is unpivoted into (position, value) and counted by both, a partial aggregate, so rows
    are read once and neither a column's values nor a frequent value meet in one task.  Values
    are told apart by their text (columns of arrays, maps and structs by their JSON text).
    """
    plain = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    items = []
    for i, c in enumerate(columns):
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            text = (x + F.lit(0.0).cast(kind)).cast("string")  # -0.0 is 0.0
        elif isinstance(kind, T.BinaryType):
            text = F.hex(x)
        else:
            text = x.cast("string") if isinstance(kind, plain) else F.when(x.isNotNull(), F.to_json(F.struct(x)))
        items.append(F.struct(F.lit(i).alias("position"), text.alias("value")))
    return df.select(F.explode(F.array(*items)).alias("kv")).groupBy("kv.position", "kv.value").agg(F.count(F.lit(1)).alias("n"))


def column_counts(df: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """(column, rows, nulls, distinct) for every column, one row each, zeros for an empty table, and
    ``more`` aggregates over the column's (value, n), all from one look at the table."""
    columns = list(columns)
    kinds = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    if not columns:
        return kinds.selectExpr("column", "0L AS rows", "0L AS nulls", "0L AS distinct")
    per = value_counts(df, columns).groupBy("position").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"),
        F.count("value").alias("distinct"), *[a.alias(n) for n, a in more.items()])
    zero = F.lit(0).cast("long")
    return kinds.join(per, "position", "left").select(
        "column", *[F.coalesce(c, zero).alias(c) for c in ("rows", "nulls", "distinct")], *more)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nulls, distinct) for every column, one row each, zeros for an empty table."""
    return column_counts(df, columns)


def distinct_scalars(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The distinct counts of ``columns`` as scalars, to join what one aggregate gives."""
    names = [f"d{i}" for i in range(len(columns))]
    wide = [F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct"))), F.lit(0).cast("long")).alias(n)
            for c, n in zip(columns, names)]
    found = stats_scalar(distinct_counts(df, columns).agg(*wide)) if wide else None
    return [found[n] for n in names]


def stats_scalar(stats: DataFrame) -> Column:
    """Turn a one-row statistics DataFrame into a struct scalar subquery.

    Fields are read with ``s["name"]``; Spark runs the subquery once and inlines
    it, so no cross join and no driver round trip is needed.
    """
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()




def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    salt_buckets: int = 64, out: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group in ``order`` (a unique order).

    Two stages so that a hot group never sorts in one task: stage 1 keeps the
    top ``k`` per (group, hash bucket of the row); stage 2 ranks at most
    ``k * salt_buckets`` candidates per group.  ``out`` names an optional
    1-based rank column.
    """
    group = list(group)
    salt = F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % salt_buckets
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    res = stage1.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= k)
    if out:
        res = res.withColumnRenamed("_r2", out)
    return res.drop("_salt", "_r1", "_r2")

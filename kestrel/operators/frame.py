"""Projection, filters, joins, sort/limit and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.plans.distributed import carry_last, distinct_counts

# ---------------------------------------------------------------- B: projection


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B1: rename; names not in the table are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


_CASTS = {"int": "bigint", "integer": "bigint", "float": "double", "double": "double",
          "str": "string", "string": "string", "bool": "boolean", "boolean": "boolean"}


def _converted(c: str, t: str) -> Column:
    t = t.lower()
    if t in ("datetime", "date", "timestamp"):
        return scalars.parse_mixed_date(F.col(c).cast("string"))
    if t in ("bool", "boolean"):
        return scalars.parse_bool(F.col(c))
    if t in ("int", "integer"):
        return F.col(c).cast("string").try_cast("double").try_cast("bigint")
    return F.col(c).cast("string").try_cast(_CASTS.get(t, t))


def convert_column_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """B2: typed cast with coercion; unparseable values become null.

    ``datetime`` goes through the mixed-format parser (H12), ``bool`` through the
    yes/no parser (H16); other types use ``try_cast``.
    """
    return df.withColumns({c: _converted(c, t) for c, t in types.items() if c in df.columns})


def convert_column_types_with_errors(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """B2: converted frame plus the per-column error list (values that were
    non-null before and null after), computed in one aggregate."""
    cols = [c for c in types if c in df.columns]
    errs = df.agg(*[F.count_if(F.col(c).isNotNull() & _converted(c, types[c]).isNull()).alias(c)
                    for c in cols]).unpivot([], cols, "column", "failed")
    return convert_column_types(df, types), errs


def predicate(df: DataFrame, conditions: Iterable[Mapping]) -> Column:
    """AND of ``{column, operator, value}`` conditions.

    Semantics kept from pandas: ``!=`` keeps nulls (S3); ``like`` is a
    case-insensitive regex *contains* and null is false (S5); ``in`` takes a
    list.  Unknown columns are skipped.
    """
    parts: list[Column] = []
    for cond in conditions:
        c, op, v = cond["column"], cond.get("operator", "="), cond.get("value")
        if c not in df.columns:
            continue
        col = F.col(c)
        if op in ("=", "=="):
            parts.append(col == F.lit(v))
        elif op == "!=":
            parts.append(~col.eqNullSafe(F.lit(v)))
        elif op == ">":
            parts.append(col > F.lit(v))
        elif op == "<":
            parts.append(col < F.lit(v))
        elif op == ">=":
            parts.append(col >= F.lit(v))
        elif op == "<=":
            parts.append(col <= F.lit(v))
        elif op == "in":
            parts.append(col.isin(list(v)))
        elif op == "like":
            parts.append(F.coalesce(col.cast("string").rlike("(?i)" + str(v)), F.lit(False)))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_data(df: DataFrame, conditions: Iterable[Mapping]) -> DataFrame:
    """Conjunctive filter; Catalyst pushes the comparisons to the scan."""
    return df.where(predicate(df, conditions))


def cross_filter(df: DataFrame, selections: Mapping[str, object]) -> DataFrame:
    """Slicer; values compared as strings, ``'all'``/empty skip the column."""
    out = df
    for c, v in selections.items():
        if c in df.columns and v not in (None, "", "all", "All"):
            out = out.where(F.col(c).cast("string") == F.lit(str(v)))
    return out


def slicer_options(df: DataFrame, columns: Sequence[str], max_values: int = 20) -> DataFrame:
    """(dimension, value) options for dimensions with fewer than ``max_values`` values.

    Distinct values are counted per column with one aggregate over the unpivoted
    table; only columns below the bound are kept, so the output is bounded.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv"))
    pairs = long.select("kv.*").where(F.col("value").isNotNull()).distinct()
    counts = pairs.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"))
    return pairs.join(counts.where(F.col("n_values") < max_values), "dimension").select("dimension", "value")


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """``start <= date <= end`` after coercion to timestamp."""
    c = F.col(column).cast("timestamp")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (c <= F.lit(end).cast("timestamp"))
    return df.where(cond)


def relative_range(df: DataFrame, column: str, days: int, reference=None, offset_days: int = 0,
                   fallback_to_all: bool = False) -> DataFrame:
    """Rows in ``(ref - offset - days, ref - offset]``.

    ``reference`` defaults to the latest timestamp in the column (a scalar
    subquery), never the wall clock.  With ``fallback_to_all`` an empty window
    returns every row, as the reference does.
    """
    ts = F.col(column).cast("timestamp")
    ref = F.lit(reference).cast("timestamp") if reference is not None else df.agg(F.max(ts)).scalar()
    hi = ref - F.make_interval(days=F.lit(offset_days))
    lo = hi - F.make_interval(days=F.lit(days))
    cond = (ts > lo) & (ts <= hi)
    if not fallback_to_all:
        return df.where(cond)
    any_hit = df.agg(F.max(cond.cast("int"))).scalar()
    return df.where(cond | F.coalesce(any_hit, F.lit(0)).eqNullSafe(F.lit(0)))


def search(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column contains ``query`` (lower-case, literal)."""
    cols = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    q = query.lower()
    cond = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False))
                                       for c in cols], F.lit(False))
    return df.where(cond)


_ID_HINTS = ("id", "key", "code", "uuid", "index")


def column_drop_evidence(df: DataFrame) -> DataFrame:
    """B8 evidence: one aggregate pass beside the distinct counts, one row per column.

    Columns: column, dtype, n, missing_pct, n_distinct, is_id_name, looks_url,
    is_sequential (ints with n_distinct = n and max-min = n-1).
    """
    fields = df.schema.fields
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"m{i}")]
        if f.dataType.typeName() in ("integer", "long", "short"):
            aggs += [(F.max(c) - F.min(c)).alias(f"r{i}")]
        else:
            aggs += [F.lit(None).cast("long").alias(f"r{i}")]
        if f.dataType.typeName() == "string":
            aggs += [F.avg(F.coalesce(c.rlike(r"^(https?://|www\.)|^[A-Za-z0-9_\-]{32,}$").cast("int"), F.lit(0))).alias(f"u{i}")]
        else:
            aggs += [F.lit(0.0).alias(f"u{i}")]
    row = df.agg(*aggs)
    per_col = row.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col("__n").alias("n"), (F.col(f"m{i}") * 100.0 / F.col("__n")).alias("missing_pct"),
                 F.col(f"r{i}").alias("int_range"),
                 F.col(f"u{i}").alias("url_share"))
        for i, f in enumerate(fields)])).alias("s")).select("s.*")
    found = distinct_counts(df, df.columns).select("column", F.col("distinct").alias("n_distinct"))
    per_col = per_col.join(found, "column")
    lname = F.lower(F.col("column"))
    id_name = reduce(lambda a, b: a | b, [lname.endswith(h) | (lname == h) for h in _ID_HINTS])
    return per_col.withColumns({
        "is_id_name": id_name,
        "is_date_type": F.col("dtype").isin("timestamp", "timestamp_ntz", "date"),
        "is_constant": F.col("n_distinct") <= 1,
        "is_sequential": (F.col("int_range") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")),
        "near_unique_string": (F.col("dtype") == "string") & (F.col("n_distinct") > 0.95 * F.col("n")),
    })


def drop_columns_by_rule(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop ids, dates, URL/token columns, >50 % missing, constants,
    near-unique strings and sequential integers.  The rule evaluation is one
    aggregate; only the list of column names reaches the driver."""
    ev = column_drop_evidence(df)
    bad = ev.where(F.col("is_id_name") | F.col("is_date_type") | (F.col("url_share") > 0.5)
                   | (F.col("missing_pct") > 50) | F.col("is_constant") | F.col("near_unique_string")
                   | F.col("is_sequential"))
    names = [r["column"] for r in bad.select("column").collect()]  # bounded by the column count
    return df.drop(*[c for c in names if c not in keep])


def select_by_type(df: DataFrame, kind: str = "numeric", limit: int = 10, min_distinct: int = 3) -> list[str]:
    """First ``limit`` numeric or categorical columns without id-like names
    and with at least ``min_distinct`` values (counted by ``distinct_counts``)."""
    numeric = ("double", "float", "int", "bigint", "smallint", "decimal")
    cands = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        is_num = t.startswith(numeric)
        if (kind == "numeric") != is_num or (kind != "numeric" and t != "string"):
            continue
        ln = f.name.lower()
        if any(ln.endswith(h) or ln == h for h in _ID_HINTS):
            continue
        cands.append(f.name)
    if not cands:
        return []
    found = {r["column"]: r["distinct"] for r in distinct_counts(df, cands).collect()}  # one row per column
    return [c for c in cands if found[c] >= min_distinct][:limit]


# ---------------------------------------------------------------- C: joins


def join_tables(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
                how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
                null_safe: bool = False, spread: bool = False) -> DataFrame:
    """Equi-join; clashing non-key names get ``_x``/``_y`` like pandas.

    Catalyst/AQE choose broadcast, shuffle-hash or sort-merge from runtime sizes;
    no hint is given because neither side has a proven size bound.  With
    ``null_safe`` null keys match each other (S4, pandas ``merge``).  ``spread``
    is for keys that repeat on both sides, where a few small input files grow to
    many pairs: the left rows are dealt by all their columns to as many tasks as
    there are shuffle partitions or cores, whichever is more, before they are joined.
    """
    if spread:
        spark = left.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        left = left.repartition(n, *[F.col(f"`{c}`") for c in left.columns])
    left_on, right_on = list(left_on), list(right_on)
    shared = (set(left.columns) & set(right.columns))
    same_keys = [l for l, r in zip(left_on, right_on) if l == r]
    clash = shared - set(same_keys)
    lren = {c: c + suffixes[0] for c in clash}
    rren = {c: c + suffixes[1] for c in clash}
    L = left.withColumnsRenamed(lren).alias("_l")
    R = right.withColumnsRenamed(rren).alias("_r")
    conds = []
    for l, r in zip(left_on, right_on):
        lc = F.col(f"_l.{lren.get(l, l)}")
        rc = F.col(f"_r.{rren.get(r, r)}")
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    cond = reduce(lambda a, b: a & b, conds)
    joined = L.join(R, cond, how)
    cols = []
    for c in L.columns:
        if c in same_keys:
            cols.append(F.coalesce(F.col(f"_l.{c}"), F.col(f"_r.{c}")).alias(c) if how in ("right", "outer", "full")
                        else F.col(f"_l.{c}"))
        else:
            cols.append(F.col(f"_l.{c}"))
    cols += [F.col(f"_r.{c}") for c in R.columns if c not in same_keys]
    return joined.select(*cols)


def aggregate_back(df: DataFrame, key: str, column: str, func: str = "min", out: str | None = None) -> DataFrame:
    """Attach a per-key aggregate (e.g. first activity date) to every row.

    Expressed as group-by + join rather than a window: the partial aggregate
    shrinks hot keys before the shuffle, and the join is skew-split by AQE.
    """
    out = out or f"{func}_{column}"
    agg = df.groupBy(key).agg(getattr(F, func)(column).alias(out))
    return df.join(agg, key, "left")


def topk_keys(df: DataFrame, key: str, k: int = 20, weight: str | None = None) -> DataFrame:
    """The ``k`` most frequent (or heaviest) keys, ties broken by key (C3 helper).

    The result is bounded by ``k`` rows, so it may be broadcast.
    """
    metric = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(metric.alias("_w"))
            .orderBy(F.desc("_w"), F.asc(key)).limit(k).select(key))


def topk_membership(df: DataFrame, key: str, k: int = 20, weight: str | None = None) -> DataFrame:
    """Keep rows whose key is among the top ``k`` by count (semi join to a
    broadcast k-row list)."""
    return df.join(F.broadcast(topk_keys(df, key, k, weight)), key, "left_semi")


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str,
                out: str, default=None, bounded: bool = True) -> DataFrame:
    """C4: small lookup (rates, encodings); unmatched rows get ``default``.

    ``bounded=True`` states that the lookup table has a fixed size (literal
    rates, category codes) and is broadcast; otherwise AQE decides.
    """
    lk = lookup.select(F.col(lookup_key).alias("_lk"), F.col(value).alias("_lv"))
    if bounded:
        lk = F.broadcast(lk)
    res = df.join(lk, F.col(key) == F.col("_lk"), "left")
    return res.withColumn(out, F.coalesce(F.col("_lv"), F.lit(default))).drop("_lk", "_lv")


def with_scenarios(df: DataFrame, scenarios: Sequence[Mapping], name_col: str = "scenario") -> DataFrame:
    """Every scenario applied to every row.

    Scenarios are a short literal list (a parameter, not data), so they are
    attached as an array literal and exploded: the fan-out is bounded by the
    parameter count and no join is planned.
    """
    arr = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return df.withColumn("_sc", F.explode(arr)).select("*", "_sc.*").drop("_sc").withColumnRenamed("name", name_col)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              right_cols: Sequence[str], suffix: str = "_right") -> DataFrame:
    """C7 as-of join: for every left row, the latest right row with
    ``right_ts <= left_ts`` in the same ``by`` group.

    Both sides are unioned, right rows before left rows at equal time, and the right row is
    carried forward over a range scan, so a group with a third of all events spreads over many
    tasks; no range join.  The whole right row is carried: its nulls stay nulls.  Of right rows
    at the same time the one with the largest values counts.  Null keys and null times match
    nothing, as in SQL; left rows are all kept.  A right column whose name the left has gets
    ``suffix``.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    rc = list(right_cols)
    rrow, lrow = F.struct(*[F.col(f"`{c}`") for c in rc]), F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rtype, ltype = right.select(rrow.alias("r")).schema["r"].dataType, left.select(lrow.alias("l")).schema["l"].dataType

    def side(df, ts, n, l, r):
        return df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col(f"`{ts}`").alias("_t"),
                         F.lit(n).alias("_side"), l.alias("_l"), r.alias("_r"))

    known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [*by, right_ts]])
    u = side(left, left_ts, 1, lrow, F.lit(None).cast(rtype)).unionByName(
        side(right.where(known), right_ts, 0, F.lit(None).cast(ltype), rrow))
    hit = carry_last(u, keys, ["_t", "_side", "_r", F.xxhash64("_l")], "_r", "_hit").where(F.col("_side") == 1)
    return hit.select("_l.*", *[F.col(f"_hit.`{c}`").alias(c + suffix if c in left.columns else c) for c in rc])


# ---------------------------------------------------------------- F: sort / limit


def order_limit(df: DataFrame, by: Sequence[str | Column], n: int) -> DataFrame:
    """``orderBy(...).limit(n)`` — planned as TakeOrderedAndProject
    (per-task top-n, then a merge), never a full sort."""
    return df.orderBy(*by).limit(n)


def top_n(df: DataFrame, value: str, n: int, tie_breaker: Sequence[str], largest: bool = True) -> DataFrame:
    """``nlargest``/``nsmallest`` with ties cut by the given key order."""
    o = F.desc(value) if largest else F.asc(value)
    return df.orderBy(o, *[F.asc(t) for t in tie_breaker]).limit(n)


def sort_by_parsed(df: DataFrame, column: str, descending: bool = True, tie_breaker: Sequence[str] = ()) -> DataFrame:
    """order by the currency-stripped numeric value of a string column, equal values by
    ``tie_breaker``, values that are no number last."""
    key = scalars.clean_numeric(F.col(column))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *[F.asc(c) for c in tie_breaker])


def preview(df: DataFrame, rows: int = 100, columns: int = 7, order: Sequence[str] = ()) -> DataFrame:
    """first ``rows`` rows of the first ``columns`` columns, by ``order`` and then by the
    columns shown; without an order any rows (a table has none of its own)."""
    shown = df.columns[:columns]
    picked = df.orderBy(*order, *[c for c in shown if c not in order]) if order else df
    return picked.limit(rows).select(*shown)


# ---------------------------------------------------------------- G: set operations


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: ``concat`` by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicate rows (whole row by default).

    Counting distinct structs keeps null-containing rows, as pandas does.
    """
    cols = list(subset or df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.struct(*cols)).alias("n_distinct")).withColumn(
        "n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def drop_exact_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-row (or subset) duplicate removal."""
    return df.dropDuplicates(list(subset) if subset else None)


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    """INTERSECT [ALL]."""
    return a.intersectAll(b) if all_rows else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    """EXCEPT [ALL]."""
    return a.exceptAll(b) if all_rows else a.subtract(b)


def dual_membership(df: DataFrame, flag_a: Column, flag_b: Column) -> DataFrame:
    """Counts of rows flagged in a, in b and in both."""
    return df.agg(F.count_if(flag_a).alias("n_a"), F.count_if(flag_b).alias("n_b"),
                  F.count_if(flag_a & flag_b).alias("n_both"))

"""File sources, sinks, the temp-view catalog and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.scalars import NA_TOKENS, na_to_null
from kestrel.plans.distributed import global_rank


def _null_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Apply the NA-token rule to every string column (one ``nullValue`` option
    cannot express a token list)."""
    return df.withColumns({f.name: na_to_null(F.col(f.name), tokens)
                           for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             sep: str = ",", na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """A1: CSV scan.  With a schema, cells are read as strings, NA tokens are
    nulled and values are ``try_cast`` to the schema types (bad -> null);
    without one every column stays a string (no inference pass over the data)."""
    if schema is None:
        raw = spark.read.csv(path, header=header, sep=sep, inferSchema=False)
        return _null_tokens(raw, na_tokens)
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    as_str = T.StructType([T.StructField(f.name, T.StringType()) for f in st.fields])
    raw = _null_tokens(spark.read.csv(path, header=header, sep=sep, schema=as_str), na_tokens)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])


def read_tsv(spark: SparkSession, path: str, schema=None, header: bool = True,
             na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """A2: tab-separated scan (the reference read these with a comma)."""
    return read_csv(spark, path, schema=schema, header=header, sep="\t", na_tokens=na_tokens)


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """A3: a JSON document (array -> rows, object -> one row) or JSON lines."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """A4: text files; ``whole`` gives one row per file with its path."""
    df = spark.read.text(path, wholetext=whole)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_files_with_lineage(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", **options) -> DataFrame:
    """Several files of one format, unioned by name, with ``_source_file``."""
    frames = []
    for p in paths:
        df = spark.read.format(fmt).options(**options).load(p)
        frames.append(df.withColumn("_source_file", F.col("_metadata.file_name")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Named frames unioned by column name, tagged with ``_source_file``."""
    tagged = [df.withColumn("_source_file", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_if_same_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """Union when all column sets are equal, else the frame with most rows
    (one count per frame — scalars only reach the driver)."""
    sets = {frozenset(df.columns) for df in frames}
    if len(sets) == 1:
        return reduce(lambda a, b: a.unionByName(b), frames)
    counts = [df.count() for df in frames]
    return frames[max(range(len(frames)), key=lambda i: counts[i])]


def sample_exact(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all rows when fewer), chosen by a seeded hash of
    ``key``: repeatable, and planned as a per-task top-n + merge."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    return df.orderBy(h, *key).limit(n)


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Bernoulli sample by a seeded hash of ``key`` (stable across reruns
    and executor loss, unlike ``rand``)."""
    h = F.abs(F.xxhash64(F.lit(seed), *[F.col(k) for k in key])) % 1_000_000
    return df.where(h < int(fraction * 1_000_000))


def stratified_sample(df: DataFrame, label: str, fraction: float, key: Sequence[str], seed: int = 42,
                      min_class: int = 10) -> DataFrame:
    """round(n x fraction) rows.  When the smallest class has at least ``min_class``
    rows, every class gets its exact share: the whole part of its rows x size / n, and
    what is left over goes to the largest remainders (ties by class); else the sample is
    uniform, all rows being one class.  In a class the rows with the least MD5 of seed
    and ``key`` (unique) are taken, so reruns agree; ``_sample_mode`` says which it was.

    Only (class, hash) is ranked, on a range-partitioned scan that splits a large class
    over tasks; the rows themselves meet the last hash of their class, one row a class,
    and are not moved.  A null label is a class of its own; an empty table gives no rows."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.agg(F.min("_n")).first()[0] or 0
    stratified = smallest >= min_class
    rows = df.withColumn("_class", F.col(label) if stratified else F.lit(1)).withColumn("_h", h)
    sizes = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    share = F.round(total * F.lit(fraction)).cast("long") * F.col("_n")  # over total, in whole numbers
    parts = sizes.select("_class", "_n", F.call_function("div", share, total).alias("_whole"), (-(share % total)).alias("_left"))
    missing = parts.agg(F.round(F.sum("_n") * F.lit(fraction)).cast("long") - F.sum("_whole")).scalar()
    quota = global_rank(parts, ["_left", "_class"], out="_r").select(
        F.col("_class").alias("_c"), (F.col("_whole") + (F.col("_r") <= missing).cast("int")).alias("_quota"))
    ranked = global_rank(rows.select("_class", "_h"), ["_class", "_h"], out="_r")
    starts = ranked.groupBy("_class").agg((F.min("_r") - 1).alias("_start")).withColumnRenamed("_class", "_s")
    same = F.col("_class").eqNullSafe(F.col("_s"))
    cuts = starts.join(quota, F.col("_s").eqNullSafe(F.col("_c"))).drop("_c")
    last = ranked.join(cuts, same).where(F.col("_r") == F.col("_start") + F.col("_quota")).select("_s", F.col("_h").alias("_last"))
    out = rows.join(last, same).where(F.col("_h") <= F.col("_last"))
    return out.drop("_class", "_h", "_s", "_last").withColumn("_sample_mode", F.lit("stratified" if stratified else "uniform"))


def register(df: DataFrame, name: str, replace: bool = True) -> DataFrame:
    """A10: expose a frame to SQL by name."""
    if replace:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)
    return df


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Any SELECT over registered (or given) tables via Spark SQL."""
    for name, df in (tables or {}).items():
        register(df, name)
    return spark.sql(sql)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Csv / tsv / json / parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def log_scan(df: DataFrame, user=None, start=None, end=None, action: str | None = None,
             user_col: str = "user_id", ts_col: str = "ts", action_col: str = "event_type") -> DataFrame:
    """Audit-log filter by user, inclusive time range and action substring
    (case-insensitive); all predicates reach the parquet scan."""
    cond = F.lit(True)
    if user is not None:
        cond = cond & (F.col(user_col) == F.lit(user))
    if start is not None and end is not None:
        cond = cond & F.col(ts_col).between(F.lit(start), F.lit(end))
    if action:
        cond = cond & F.lower(F.col(action_col)).contains(action.lower())
    return df.where(cond)

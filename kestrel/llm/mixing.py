"""Mixing sources to target weights (DataFrame functions only).

Words per source are aggregated, every source gets a target by water-filling,
and each document is emitted ``floor(rate)`` times plus one copy drawn by a
hash-seeded Bernoulli trial with the fraction as probability.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and rate 0, so its documents
are not taken; equal ids decide alike, so repeated rows are copied alike; an
empty table gives an empty result; extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import boxed, cut, shuffle_partitions, unboxed

WORD = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3
SEED = "mix-1"
BROADCAST_SOURCES = 10_000  # rates of up to so many sources are broadcast, more are joined by shuffle


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` plus ``_nth`` (from 0) and ``_before_<c>``, the sum of ``c`` over the rows
    before, in a unique ``order``: dealt to tasks by ranges, written, and added up within
    each task; only one row per task is then put in order at once."""
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    scan = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    scan = scan.withColumn("_task", F.shiftright("_at", 33))
    inside = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    scan = scan.select("*", F.count(F.lit(1)).over(inside).alias("_nth"), *[F.sum(c).over(inside).alias(f"_before_{c}") for c in sums])
    tasks = scan.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("_task", F.sum("_n").over(earlier).alias("_o"), *[F.sum(f"_s_{c}").over(earlier).alias(f"_o_{c}") for c in sums])
    out = scan.join(F.broadcast(tasks), "_task")  # one row per task
    zero = F.lit(0.0)
    return out.select(*rows.columns, (F.col("_nth") + F.coalesce("_o", F.lit(0))).alias("_nth"), *[
        (F.coalesce(f"_before_{c}", zero) + F.coalesce(f"_o_{c}", zero)).alias(f"_before_{c}") for c in sums])


def targets(sizes: DataFrame, share: float = 1.0, weights=(1, 2, 3), max_rate: int = MAX_RATE) -> DataFrame:
    """``sizes`` (source, source_size), one row per source -> with target and rate.

    Sources by code point, null last, take the weights in turn.  A target stops
    at ``max_rate`` times the source's size and the excess goes to the others by
    weight.  The level where this ends is the largest of the levels reached when
    sources are capped in the order of capacity per weight, so it needs no loop.
    Sources, which may be as many as documents, are ordered by ranges."""
    named = in_order(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    s = named.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(max_rate)).alias("cap"))
    s = in_order(s, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], ("cap", "weight"))
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).select(F.struct("*").alias("w")).scalar()
    s = s.withColumn("level", (whole["size"] * float(share) - F.col("_before_cap")) / (whole["weight"] - F.col("_before_weight")))
    level = s.agg(F.max("level")).scalar()
    s = s.withColumn("target", F.least(F.col("cap"), F.col("weight") * level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "target", rate.alias("rate"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """In [0, 1), from 52 bits of the MD5 of seed and key."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / float(1 << 52)


def with_copies(sized: DataFrame) -> DataFrame:
    """``sized``: _doc_id, _source, _size and others; adds _source_size, _target and _copies."""
    sums = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").cast("long").alias("source_size"))
    rates = cut(targets(sums), "rates")
    few = rates.count() <= BROADCAST_SOURCES
    right = rates.select(F.col("source").alias("_src"), F.col("source_size").alias("_source_size"),
                         F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    joined = sized.join(F.broadcast(right) if few else right, F.col("_source").eqNullSafe(F.col("_src")))
    whole = F.floor("_rate")
    extra = F.when(uniform(F.col("_doc_id")) < F.col("_rate") - whole, 1).otherwise(0)
    return joined.withColumn("_copies", (whole + extra).cast("long")).drop("_src", "_rate")


def digest(docs: DataFrame) -> DataFrame:
    sized = docs.select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"))
    return with_copies(sized).select(F.col("_doc_id").alias("doc_id"), F.col("_size").alias("size"),
                                     F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                                     (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is taken."""
    sized = boxed(docs).select("_row", F.col("_row.doc_id").alias("_doc_id"), F.col("_row.source").alias("_source"),
                               n_words(F.col("_row.text")).alias("_size"))
    out = with_copies(sized).where(F.col("_copies") > 0)
    return unboxed(out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))

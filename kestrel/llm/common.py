"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import scratch_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage ends there, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``_row``, so that no name clashes with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 3 (null for a null id); fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): rows (node, root), root the
    smallest node of the component, for every node that has a link to another.

    Alternating large-star and small-star steps: every step is one aggregate and
    one join by node, edges are written to the shared folder between steps, and
    only a count and a checksum reach the driver.  Rounds grow with the logarithm
    of the component size."""
    ways = links.where(F.col("a") != F.col("b"))
    edges = cut(ways.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = cut(moved.unionByName(own).where(F.col("a") != F.col("b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(now)

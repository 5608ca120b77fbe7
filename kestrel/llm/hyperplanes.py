"""Embedding near-duplicates by random-hyperplane sign hashing.

Vectors of one label and dimension are hashed by the signs of random projections
in several tables.  All pairs of a bucket are verified by exact cosine in double
precision, in blocks of bounded size, a pair in the first table that brings it
together only; links are counted, and the components follow from a spanning
forest of each block.  Bits grow with the number of vectors so that buckets keep
their size, and tables with the bits so that a pair at the threshold is missed
with probability at most ``MISS``.

Defined cases: a vector that is null, zero or has null or non-finite components,
or whose label is null, links with nothing and is its own component; equal
vectors are one node with a multiplicity, so copies are not compared; a repeated
row is a vector of its own; a null id never is a component's id unless all ids in
it are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import components, cut

COSINE = 0.98
MISS = 1e-6
BUCKET = 64  # vectors that a bucket of average density has
SIDE = 512  # vectors in a block
SEED = 20


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors under one label."""
    bits = min(20, max(4, round(math.log2(max(n, 1) / BUCKET + 1))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - together))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def is_usable() -> Column:
    """Never null."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(some, F.lit(False))


def codes(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``nodes`` (node, label, embedding, weight) plus ``codes``, one per table."""
    power = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch.column("embedding").to_pylist()]
            out = np.zeros((len(vectors), tables), np.int32)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                p = cache.setdefault(int(dim), planes(int(dim), bits, tables))
                rows = np.flatnonzero(dims == dim)
                side = np.stack([vectors[i] for i in rows]) @ p > 0
                out[rows] = side.reshape(len(rows), tables, bits) @ power
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int32()))], names=[*names, "codes"])

    names = list(nodes.columns)
    return nodes.mapInArrow(run, nodes.schema.simpleString()[7:-1] + ",codes:array<int>")


def compare(left: pd.DataFrame, right: pd.DataFrame | None, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks (or one with itself): links added to each row, in left and
    then right order, and a spanning forest (rows i, j) of all links."""
    v = np.stack(left["embedding"].to_numpy()).astype(np.float64)
    c = np.stack(left["codes"].to_numpy())
    w = left["weight"].to_numpy()
    v2, c2, w2 = (v, c, w) if right is None else (np.stack(right["embedding"].to_numpy()).astype(np.float64), np.stack(right["codes"].to_numpy()), right["weight"].to_numpy())
    near = (v @ v2.T) / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v2, axis=1)[None, :]) >= cosine
    if right is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    first = ~(c[i, :table] == c2[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    one = np.bincount(i[first], weights=w2[j[first]], minlength=len(v))
    two = np.bincount(j[first], weights=w[i[first]], minlength=len(v2))
    if right is None:
        n, j_, total = len(v), j, one + two
    else:
        n, j_, total = len(v) + len(v2), j + len(v), np.concatenate([one, two])
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j_])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j_, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(n))
    return total, tied, label[tied]


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, label, embedding, weight; per node links ``n`` and forest
    ``to``), both written.  ``weight`` counts the vectors that are equal."""
    good = vectors.where(is_usable()).select("label", "embedding")
    groups = good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"))
    nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()).select("node", "label", "embedding", "weight"), "nodes")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(most, cosine)
    coded = cut(codes(nodes, bits, tables).withColumn("dim", F.size("embedding")), "codes")
    seat = coded.select("node", "label", "dim", F.posexplode("codes").alias("table", "code"))
    full = cut(seat.groupBy("label", "dim", "table", "code").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "buckets")
    # a bucket of many blocks becomes block pairs; a vector goes to as many pairs as there are blocks
    seat = seat.join(full, ["label", "dim", "table", "code"]).withColumn("many", F.ceil(F.col("size") / SIDE).cast("int"))
    seat = seat.withColumn("own", (F.pmod(F.xxhash64("node"), F.col("many"))).cast("int"))
    seat = seat.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    seat = seat.select("node", "label", "dim", "table", "code", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    seat = seat.join(coded.select("node", "embedding", "codes", "weight"), "node")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, table = int(rows["x"].iat[0]), int(rows["y"].iat[0]), int(rows["table"].iat[0])
        left = rows[rows["own"] == x]
        right = None if x == y else rows[rows["own"] == y]
        if not len(left) or (right is not None and not len(right)):
            return pd.DataFrame({"node": [], "n": [], "to": []}).astype("int64")
        total, tied, root = compare(left, right, table, cosine)
        ids = np.concatenate([left["node"], [] if right is None else right["node"]]).astype(np.int64)
        to = ids.copy()
        to[tied] = ids[root]
        hit = (total > 0) | (to != ids)
        return pd.DataFrame({"node": ids[hit], "n": total[hit].astype(np.int64), "to": to[hit]})

    found = seat.groupBy("label", "dim", "table", "code", "x", "y").applyInPandas(block, "node bigint, n bigint, to bigint")
    return nodes, cut(found, "found")


def digest(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    rows = vectors.select("vec_id", "label", "embedding")
    nodes, found = links(rows, cosine)
    count = cut(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
    root = cut(components(found.select(F.col("node").alias("a"), F.col("to").alias("b")).distinct()), "roots")
    info = nodes.join(count, "node", "left").join(root, "node", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = cut(rows.where(is_usable()).join(info, ["label", "embedding"]).select("vec_id", "n_links", "root"), "named")
    least = cut(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    linked = named.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where(~is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A signature component is the first arrival, over all shingles of a document, of
a Poisson process in time and weight: a shingle of weight w owns the points with
level at most w.  Levels are split into dyadic intervals (0, 1], (1, 2], (2, 4],
..., each with a process of its own rate; a document looks at the intervals its
weight reaches and drops points above its weight.  Two documents share a
component with probability equal to their weighted Jaccard similarity, and the
points to look at are about m (ln m + 4) for a document of any length.

Signatures are banded.  In every bucket, members are verified by exact multiset
overlap against one pivot (a second one for those that are not of the first one's
class), and members already connected are not compared again.  What is still a
stranger to its bucket's class then meets all members of other classes there.
Pairs that cannot be near are ruled out inside that join by a bitmap: a text's
bitmap holds the parity of its shingle counts by residue, so the bits in which two
bitmaps differ never outnumber the shingles in which the texts differ.  The bound
is exact; what it leaves is verified.

Defined cases: a null text is the empty text; texts without words are copies of
each other if equal and are like nothing else; equal texts are one node, so
groups of copies of any size cost one row each; ids may repeat or be null, a class
id is the smallest id in the class (null if it has none), and classes with the same
id stay apart; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import boxed, components, cut, unboxed
from kestrel.llm.shingles import blocks, mix, shingle_hashes

THRESHOLD = 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares a band with probability 1 - 3e-6
BITS = 1024  # of a text's bitmap
PIVOTS = 1024  # strangers of a bucket that one task holds against the bucket's members


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from a 64-bit hash."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bags(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], hashes[new], np.diff(np.concatenate([new, [len(doc)]]))


def bitmaps(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS / 64) words; bit r is the parity of the counts of items equal to r modulo BITS."""
    words = BITS // 64
    out = np.zeros(n * words, np.uint64)
    odd = count % 2 == 1
    bit = item[odd] % np.uint64(BITS)
    place = doc[odd] * words + (bit // np.uint64(64)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (bit % np.uint64(64)))
    return out.reshape(n, words)


def signatures(hashes: np.ndarray, begin: np.ndarray, m: int, bag: tuple | None = None) -> np.ndarray:
    """(documents, m) first-arrival times as float32; infinite without shingles."""
    n = len(begin) - 1
    out = np.full((n, m), np.inf)
    doc, item, weight = bag or bags(hashes, begin)
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = (math.log(m) + 4) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    # dyadic level intervals that a weight reaches: 0 -> (0, 1], j -> (2^(j-1), 2^j]
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    while len(todo):
        pick = np.isin(doc, todo)
        d0, i0, w0, r0 = doc[pick], item[pick], weight[pick], reach[pick]
        copies = r0 + 1
        d, w = np.repeat(d0, copies), np.repeat(w0, copies)
        j = np.arange(len(d)) - np.repeat(np.cumsum(copies) - copies, copies)
        base = mix(np.repeat(i0, copies) + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        low = np.where(j > 0, 2.0 ** (j - 1), 0.0)
        width = np.where(j > 0, low, 1.0)
        time = np.zeros(len(d))
        point = 0
        while len(d):
            point += 1
            seed = mix(base + np.uint64(point * 0xE7037ED1A0B428DB & (1 << 64) - 1))
            time = time - np.log(_unit(seed)) / (width * m)
            live = time <= horizon[d]
            d, w, base, low, width, time, seed = (x[live] for x in (d, w, base, low, width, time, seed))
            second = mix(seed + np.uint64(0x8EBC6AF09C88C6E3))
            level = low + width * _unit(mix(second))
            own = level <= w
            np.minimum.at(out, (d[own], (second[own] % np.uint64(m)).astype(np.int64)), time[own])
        todo = todo[~np.isfinite(out[todo]).all(axis=1)]  # some component saw no point yet: look further
        horizon[todo] *= 2
    return out.astype(np.float32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit bucket keys, the band's number mixed in."""
    bits = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key + bits[:, :, r])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted items, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def content(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def nodes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, content; nodes: node, content, keys, total, bits), both written.
    A node is a distinct text with its number of shingles and its bitmap; ``keys`` is
    empty for a text without words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("content", T.StringType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("total", T.LongType()),
                           T.StructField("bits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            total: list = []
            bits: list = []
            for _, part in blocks(batch.column(1).to_pylist()):
                h, begin = shingle_hashes(part)
                bag = bags(h, begin)
                made = band_keys(signatures(h, begin, bands * rows, bag), bands, rows)
                keys += [k if hi > lo else [] for k, lo, hi in zip(made, begin[:-1], begin[1:])]
                total += np.diff(begin).tolist()
                bits += list(bitmaps(*bag, len(part)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64())),
                                              pa.array(total, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=schema.names)

    signed = cut(docs.select("doc_id", "text", content(F.col("text")).alias("content")).mapInArrow(run, schema), "signed")
    distinct = signed.groupBy("content").agg(F.first(F.struct("keys", "total", "bits")).alias("made")).select("content", "made.*")
    return signed.select("doc_id", "content"), cut(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")


def may_be_near(left: str, right: str, threshold: float) -> Column:
    """Whether two nodes (structs with total and bits) can reach ``threshold``: similarity
    (S - D) / (S + D), with S shingles in both and D in which they differ, asks for
    D <= S (1 - threshold) / (1 + threshold), and bitmaps differ in D bits at most."""
    differ = sum((F.bit_count(F.col(f"{left}.bits")[i].bitwiseXOR(F.col(f"{right}.bits")[i])) for i in range(1, BITS // 64)),
                 F.bit_count(F.col(f"{left}.bits")[0].bitwiseXOR(F.col(f"{right}.bits")[0])))
    most = (F.col(f"{left}.total") + F.col(f"{right}.total")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(F.col(f"{left}.total") - F.col(f"{right}.total")) <= most) & (differ <= most)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` (a, b) that may be near with their exact similarity; ``texts`` is
    (node, text, sketch).  Work is by pair, so a pivot in many pairs is not one task's load."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("sketch").alias("sketch_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("sketch").alias("sketch_a")), "a")
    both = both.where(may_be_near("sketch_a", "sketch_b", threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag_a = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = np.zeros(len(a))
            for first, part in blocks(batch.column(3).to_pylist()):
                h, begin = shingle_hashes(part)
                doc, item, count = bags(h, begin)
                bound = np.searchsorted(doc, np.arange(len(part) + 1))
                for i, (lo, hi) in enumerate(zip(bound[:-1], bound[1:]), start=first):
                    if a[i] != last:  # rows come sorted by pivot
                        h_a, begin_a = shingle_hashes([batch.column(2)[i].as_py().encode()])
                        last, bag_a = a[i], bags(h_a, begin_a)[1:]
                    out[i] = overlap(bag_a, (item[lo:hi], count[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` after more ``links``: the components of the old components."""
    ends = links
    for end in ("a", "b"):
        at = root.select(F.col("node").alias(end), F.col("root").alias("r"))
        ends = ends.join(at, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    merged = cut(components(ends.select("a", "b").distinct()), "merged").select(F.col("node").alias("root"), F.col("root").alias("new"))
    fresh = merged.select(F.col("root").alias("node")).join(root, "node", "left_anti").select("node", F.col("node").alias("root"))
    return root.unionByName(fresh).join(merged, "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _strangers(seats: DataFrame, root: DataFrame) -> DataFrame:
    """``seats`` (bucket, node, met, home) with ``of``, the class of the node, where it
    is not the class of the bucket's first pivot (``home``)."""
    home = root.select(F.col("node").alias("home"), F.col("root").alias("home_of"))
    at = seats.join(root, "node", "left").join(home, "home", "left")
    return at.select("bucket", "node", "met", "home", F.coalesce("root", "node").alias("of"),
                     F.coalesce("home_of", "home").alias("home_of")).where(F.col("of") != F.col("home_of"))


def _top(seats: DataFrame) -> DataFrame:
    """Of every bucket, the member that meets most others over all bands: the source of a group of edited copies."""
    top = seats.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("top"))
    return top.select("bucket", (-F.col("top.node")).alias("pivot"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, content, class_id, class_content; links a, b, similarity between
    nodes).  A class is a component of the links; ``class_id`` and ``class_content`` are
    the id and MD5 of the row that stands for it: smallest id, nulls last, then MD5."""
    members, node = nodes(docs, bands, rows)
    buckets = node.select("node", F.explode("keys").alias("bucket"))
    size = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low")).where(F.col("size") > 1)
    sized = cut(buckets.join(size, "bucket"), "sized")
    wanted = sized.select("node").distinct().join(node.select("node", "content", F.struct("total", "bits").alias("sketch")), "node")
    bodies = docs.select(content(F.col("text")).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(bodies.join(wanted, "content").groupBy("node").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")), "texts")

    # every member against its bucket's pivot
    crowd = sized.where(F.col("size") > 2).select("bucket", "node", "size")
    seats = crowd.join(crowd.groupBy("node").agg(F.sum("size").alias("met")), "node")
    seats = cut(seats.join(_top(seats), "bucket").select("bucket", "node", "met", F.col("pivot").alias("home")), "seats")
    two = sized.where((F.col("size") == 2) & (F.col("node") != F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = two.unionByName(seats.where(F.col("node") != F.col("home")).select(*_pair("home", "node"))).distinct()
    tested = cut(verify(pairs, texts, threshold), "tested")
    root = cut(components(tested.where(F.col("similarity") >= threshold)), "roots")

    # strangers to that pivot's class against one of them
    strange = cut(_strangers(seats, root), "strange")
    pairs = strange.join(_top(strange), "bucket").where(F.col("pivot") != F.col("node")).select(*_pair("pivot", "node")).distinct()
    fresh = cut(verify(pairs.join(tested, ["a", "b"], "left_anti"), texts, threshold), "tested")
    tested = tested.unionByName(fresh)
    root = cut(_joined(root, fresh.where(F.col("similarity") >= threshold)), "roots")

    # what is still a stranger against all members of other classes that may be near, PIVOTS strangers at a time
    strange = cut(_strangers(seats, root), "strange")
    held = strange.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PIVOTS).cast("int").alias("parts"))
    sketch = node.select("node", F.struct("total", "bits").alias("sketch"), "keys")
    chosen = strange.join(held, "bucket").join(sketch, "node").select(
        "bucket", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("p"), "of", F.col("sketch").alias("p_sketch"), F.col("keys").alias("p_keys"))
    others = seats.join(held, "bucket").join(root, "node", "left").join(sketch, "node").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.coalesce("root", "node").alias("root"), "sketch", "keys")
    # a pair comes out of the least bucket that it shares only: one end is a stranger there too, or a bucket of two has tested it
    once = F.array_min(F.array_intersect("p_keys", "keys")) == F.col("bucket")
    pairs = chosen.join(others, ["bucket", "part"]).where((F.col("of") != F.col("root")) & may_be_near("p_sketch", "sketch", threshold) & once)
    pairs = cut(pairs.select(*_pair("p", "node")).distinct(), "pairs").join(tested, ["a", "b"], "left_anti")
    fresh = cut(verify(pairs, texts, threshold), "tested")
    tested = tested.unionByName(fresh)
    root = cut(_joined(root, fresh.where(F.col("similarity") >= threshold)), "roots")

    links = tested.where(F.col("similarity") >= threshold)
    named = members.join(node.select("content", "node"), "content").join(root, "node", "left").select(
        "doc_id", "content", F.coalesce("root", "node").alias("root"))
    named = cut(named, "named")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("stay")
    stay = named.groupBy("root").agg(least).select("root", F.col("stay.doc_id").alias("class_id"), F.col("stay.content").alias("class_content"))
    return named.join(cut(stay, "stay"), "root").select("doc_id", "content", "class_id", "class_content"), links


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its class (the smallest id in it, and the MD5 of the text
    that stays, which no other class has) and whether it stays."""
    rows, _ = classes(docs)
    first = rows.groupBy("content").agg(F.min("doc_id").alias("copy_of"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("content") == F.col("class_content"))
    return rows.join(cut(first, "copies"), "content").select("doc_id", "class_id", "class_content", "copy_of", stays.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class: the one with the smallest id, of rows with that id
    the one with the smallest MD5; a class without any id goes by the MD5 alone."""
    rows, _ = classes(docs)
    stay = cut(rows.select(_who(F.col("class_id"), F.col("class_content")).alias("_who")).distinct(), "stay")
    named = boxed(docs).select(_who(F.col("_row.doc_id"), content(F.col("_row.text"))).alias("_who"), "_row")
    return unboxed(named.join(stay, "_who", "left_semi").groupBy("_who").agg(F.first("_row").alias("_row")))


def _who(doc_id: Column, have: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), have)

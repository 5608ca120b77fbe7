"""Document fingerprints: the k smallest hashes of a text's word shingles.

A fingerprint is text (base64 of 48-bit hashes in ascending order).  Fingerprints
of parts merge into that of the whole, and a pair of them gives resemblance,
containment and the number of distinct shingles; with fewer than k shingles all
of these are exact.

Defined cases: a null text is the empty text, whose fingerprint is empty; two
empty fingerprints have likeness 1, an empty and another one 0; the empty one is
contained in every other.  ``next`` is the next row by id and then the text's hash,
after the last row the first; null ids come first; a repeated row is a document of
its own; a single document is its own next.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import shuffle_partitions
from kestrel.llm.shingles import blocks, shingle_hashes

K = 256
_KEPT_BITS = 48


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes (48 bits), ascending."""
    h = hashes >> np.uint64(64 - _KEPT_BITS)
    while len(h) > 4 * k:  # a slice that surely has k distinct values, else all of them
        least = np.unique(np.partition(h, 2 * k)[:2 * k])
        if len(least) >= k:
            return least[:k]
        h = np.unique(h)
        break
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**_KEPT_BITS / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b)) / len(a)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8")[:, 0].astype(np.uint64)


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, part in blocks(texts):
        h, begin = shingle_hashes(part)
        out += [sketch(h[lo:hi], k) for lo, hi in zip(begin[:-1], begin[1:])]
    return out


def edited(text: str, following: str) -> str:
    """The last half replaced by as many first characters of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_text, sketches(batch.column(1).to_pylist(), k)), pa.string())],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, _mark) dealt to tasks by ranges of (id, hash of text, row) and
    sorted; a task's last row, marked, is the one that follows its range.

    The third part splits the rows of one id, and copies of one text with one id, among
    tasks.  The bounds come from about a hundred rows a task, drawn by a fixed seed, and only
    balance the tasks; those, and the first id and hash of every range, reach the driver.
    A range gets one marked row.  Texts move once."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("_key"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("_row"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    place, known = F.struct("_key", "_hash", "_row"), F.struct("_key", "_hash")
    drawn = rows.select("_key", "_hash", "_row").sample(min(1.0, 100.0 * n / max(docs.count(), 1)), seed=9).collect()
    drawn = sorted(tuple(r) for r in drawn)
    bounds = sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []

    def several(values):
        return F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(v, ("_key", "_hash", "_row"))]) for v in values])

    spot = F.size(F.filter(several(bounds), lambda b: b <= place)) if bounds else F.lit(0)
    rows = rows.withColumn("_range", spot)
    firsts = sorted((r["_range"], tuple(r["f"])) for r in rows.groupBy("_range").agg(F.min(known).alias("f")).collect())
    after = {}  # first id and hash of a range -> the ranges before it; the first range follows the last
    for i, (_, first) in enumerate(firsts):
        after.setdefault(first, []).append(firsts[i - 1][0])
    dealt = rows.select("doc_id", "text", "_key", "_hash", "_range", F.lit(False).alias("_mark"))
    if after:
        leads = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h"), F.lit(r).alias("r"))
                          for (k, h), ranges in after.items() for r in ranges])
        heads = rows.where(F.array_contains(several(after), known)).groupBy("_key", "_hash").agg(
            F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
        to = F.filter(leads, lambda x: (x["k"] == F.col("_key")) & (x["h"] == F.col("_hash")))
        heads = heads.withColumn("_to", F.explode(to))
        dealt = dealt.unionByName(heads.select("doc_id", "text", "_key", "_hash", F.col("_to.r").alias("_range"), F.lit(True).alias("_mark")))
    return dealt.repartitionById(n, "_range").sortWithinPartitions("_range", "_mark", "_key", "_hash", "text").select(
        "doc_id", "text", "_mark", "_range")


def merged(parts: DataFrame, by: str, k: int = K, spread: int = 32) -> DataFrame:
    """(``by``, fingerprint, n_shingles) of all texts of each part, by merging the fingerprints
    of its rows (columns ``by`` and ``fingerprint``): in each task first, then by part and
    one of ``spread`` salts, then by part, so that no task merges the rows of a large part.

    Memory: 4,096 parts a task in the first step, one part in the others, whose rows are
    sorted by part.  Null is a part of its own; a part of empty texts has the empty fingerprint."""
    kind = parts.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), T.StructField("fingerprint", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = [to_arrow_type(kind), pa.string()]

    def together(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}

            def out() -> pa.RecordBatch:
                arrays = [pa.array(list(held), arrow[0]), pa.array([to_text(v) for v in held.values()], arrow[1])]
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for batch in batches:
                for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if part not in held and len(held) == most:
                        yield out()
                        held = {}
                    a = from_text(text or "")
                    held[part] = merge(held[part], a, k) if part in held else a[:k]
            if held:
                yield out()
        return run

    x = parts.select(by, "fingerprint").mapInArrow(together(4096), schema)
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(spread))
    x = x.repartition(shuffle_partitions(parts.sparkSession), F.col(f"`{by}`"), salt).sortWithinPartitions(by).mapInArrow(together(1), schema)
    x = x.repartition(shuffle_partitions(parts.sparkSession), F.col(f"`{by}`")).sortWithinPartitions(by).mapInArrow(together(1), schema)
    count = F.udf(lambda t: distinct(from_text(t), k), "double", useArrow=True)
    return x.withColumn("n_shingles", count("fingerprint"))


def digest(docs: DataFrame, k: int = K) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()),
                           T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
                           T.StructField("near_next", T.DoubleType()), T.StructField("n_shingles", T.DoubleType()),
                           T.StructField("contained_edited", T.DoubleType()), T.StructField("contained_next", T.DoubleType())])

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        """``texts`` has one more than ``ids``, the text after the last."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = sketches(texts, k), sketches(changed, k)
        cols = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                [to_text(s) for s in own[:-1]], [to_text(s) for s in other],
                [resemblance(a, b, k) for a, b in zip(own, other)], [resemblance(a, b, k) for a, b in zip(own, own[1:])],
                [distinct(s, k) for s in own[:-1]], [containment(a, b, k) for a, b in zip(own, other)],
                [containment(a, b, k) for a, b in zip(own, own[1:])]]
        arrays = [pa.array(c, t) for c, t in zip(cols, arrow_types)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0  # rows that wait for the text after them
        for batch in batches:
            for doc_id, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if texts and (mark or size > 1 << 20):
                    yield emit(ids, [*texts, text])
                    ids, texts, size = [], [], 0
                if not mark:  # the marked row is the last of its range
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    return in_order(docs).mapInArrow(run, schema)

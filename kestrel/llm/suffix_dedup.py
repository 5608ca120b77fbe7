"""Suffix-array deduplication of repeated byte strings.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else.  Which strings repeat is read off sorted suffixes:

1. Anchors.  In every window of ``length`` bytes the GRAM-byte string with the
   least hash is its anchor, so equal windows have equal anchors at equal places.
   Anchors whose hash comes at one place only cannot be part of a repeat.
2. For every other anchor, the stretch of text whose windows it anchors goes to
   the anchor's bucket.  Equal stretches are kept once with the number of places
   (at two or more all their windows repeat), so common passages shrink before any sort.
3. Tasks sort the suffixes of their buckets in two stages: suffixes smaller than
   their successors are sorted directly, the rest are induced by scanning the
   buckets of first bytes, and common prefixes of neighbours follow.  A window
   with a common prefix of ``length`` or more repeats.
4. Repeats go back to all places of their stretch and to the texts.

An anchor with more than HOT different stretches (say the edge of a passage that
a third of the documents have) is split by the hash of each single window first.

Defined cases: a null text is the empty text; a text below ``length`` bytes is
kept whole; repeated rows and equal texts of at least ``length`` bytes are removed
whole; an empty table gives an empty result; columns but doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut
from kestrel.llm.shingles import mix

LENGTH = 200
GRAM = 32
HOT = 8000  # different stretches of one anchor, 3 MB at most, that are sorted in one task
BLOCK = 1 << 19  # bytes of stretches that a task sorts at once (cache-sized), or one bucket
_BASE = 0x9E3779B97F4A7C15 | 1


# ---- anchors -------------------------------------------------------------------------------------

def gram_hashes(code: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on, by doubling the span."""
    h = code.astype(np.uint64) + np.uint64(1)
    span = 1
    factor = _BASE
    while span < gram:  # gram is a power of two
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor & (1 << 64) - 1
        span *= 2
    return mix(h)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the last least value among ``width`` from each place on."""
    value, place = h, np.arange(len(h), dtype=np.int32)
    span = 1
    while span * 2 <= width:
        later = value[span:] <= value[:-span]
        value, place = np.where(later, value[span:], value[:-span]), np.where(later, place[span:], place[:-span])
        span *= 2
    rest = width - span
    if rest:
        later = value[rest:] <= value[:-rest]
        place = np.where(later, place[rest:], place[:-rest])
    return place


def window_anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of each window, gram hashes); no windows in a short text."""
    if len(raw) < length:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    return sliding_argmin(h, length - GRAM + 1), h


def stretches_of(raw: bytes, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the anchors at ``places``: first and last window, and the anchor's hash."""
    anchor, h = window_anchors(raw, length)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0]))
    last = np.concatenate([edge[1:], [len(anchor)]]) - 1
    hit = np.isin(anchor[edge], places)
    return edge[hit], last[hit], h[anchor[edge[hit]]].view(np.int64)


# ---- suffix sorting in one task ------------------------------------------------------------------

def span_hashes(code: np.ndarray, depth: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... up to ``depth`` symbols from each place on, with
    zeros beyond the end."""
    h = np.zeros(len(code) + 2 * depth, np.uint64)
    h[:len(code)] = code
    out, factor = [h + np.uint64(1)], _BASE
    while 2 << len(out) - 1 <= depth:
        span, last = 1 << len(out) - 1, out[-1]
        h = last.copy()
        h[:-span] = last[:-span] * np.uint64(factor) + last[span:]
        out.append(h)
        factor = factor * factor & (1 << 64) - 1
    return out


def suffix_order(code: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``code`` sorted by their first ``depth`` symbols at least;
    ``key`` has the seven symbols from each place on, padded with zeros.  Of
    suffixes that are equal to that depth, by hash, one is sorted for all."""
    n = len(code)
    step = np.sign(np.diff(code.astype(np.int32), append=-1))  # the end is smaller than all
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[known] > 0  # than the successor: sorted directly
    chosen = np.flatnonzero(smaller)
    spans = span_hashes(code, depth)
    longest = 1 << len(spans) - 1
    whole = mix(mix(spans[-1][chosen]) + spans[-1][chosen + depth - longest])
    _, one, kin = np.unique(whole, return_index=True, return_inverse=True)
    order = chosen[one]
    kind_at = np.arange(len(order))  # which distinct suffix is at each slot of ``order``
    slots = np.arange(len(order))
    group, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    while len(slots):
        k = key[order[slots] + at]
        by = np.lexsort((k, group)) if group.any() else np.argsort(k, kind="stable")
        order[slots], kind_at[slots] = order[slots][by], kind_at[slots][by]
        k = k[by]
        begin = np.concatenate([[True], (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
        group = np.maximum.accumulate(np.where(begin, slots, 0))
        alone = begin & np.concatenate([begin[1:], [True]])
        slots, group, at, begin = slots[~alone], group[~alone], at[~alone] + 7, begin[~alone]
        if not len(slots):
            break
        # what a tied group has in common beyond is skipped: the least common prefix of its neighbours
        here = order[slots] + at
        common = np.zeros(len(slots) - 1, np.int64)
        for j in range(len(spans) - 1, -1, -1):
            common += (spans[j][here[:-1] + common] == spans[j][here[1:] + common]) << j
            np.minimum(common, depth - at[:-1], out=common)
        common = np.append(common, depth)
        common[np.append(begin[1:], True)] = depth  # the last of a group has no neighbour in it
        first = np.flatnonzero(begin)
        skip = np.minimum.reduceat(common, first)
        at = at + np.repeat(skip, np.diff(np.append(first, len(slots))))
        going = at < depth
        slots, group, at = slots[going], group[going], at[going]
    rank = np.empty(len(order), np.int64)
    rank[kind_at] = np.arange(len(order))
    order = chosen[np.argsort(rank[kin], kind="stable")]
    # the rest follow from their successors, bucket by bucket of the first symbol
    direct = np.split(order, np.searchsorted(code[order], np.arange(1, 257)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[code[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(257):
        queue = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        run = [queue]
        while len(queue):
            queue = queue[queue > 0] - 1
            queue = queue[code[queue] == c]
            run.append(queue)
        whole = np.concatenate([*run, direct[c]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[code[before] > c]
        if len(before):
            symbol = code[before]
            by = np.argsort(symbol, kind="stable")
            symbol, before = symbol[by], before[by]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, s in zip(np.split(before, cuts), symbol[np.concatenate([[0], cuts])]):
                waiting[s].append(part)
    return np.concatenate(out)


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its windows also start anywhere else in the list."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1)
    code = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    code[ends - 1] = 0  # closes a string, below all bytes
    n = len(code)
    wide = np.zeros(n + 2 * length + 14, np.uint64)
    wide[:n] = code
    key = np.zeros(n + 2 * length + 7, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | wide[j:j + len(key)]
    order = suffix_order(code, key, length)
    room = np.repeat(ends - 1, sizes + 1) - np.arange(n)  # bytes left in the string
    order = order[room[order] >= length]
    a, b = order[:-1], order[1:]
    at = 0
    while at < length and len(a):  # common prefixes of neighbours
        unused = max(0, at + 7 - length)
        same = key[a + at] >> np.uint64(9 * unused) == key[b + at] >> np.uint64(9 * unused)
        a, b, at = a[same], b[same], at + 7
    again = np.zeros(n, bool)
    again[a] = again[b] = True
    begin = ends - sizes - 1
    return [again[lo:lo + max(0, size - length + 1)] for lo, size in zip(begin.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Stretches of true flags: first and last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(lo), "last": int(hi) - 1} for lo, hi in zip(edge[::2], edge[1::2])]


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _sorted_buckets(length: int, block: int):
    """mapInArrow body over rows (route, sid, n, body) sorted by route."""

    def work(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        # a stretch at several places stands once in the sort: all its windows repeat, others find theirs in it
        sids, runs = [], []
        for (sid, n, _), found in zip(rows, repeated_windows([body for _, _, body in rows], length)):
            if n > 1:
                found[:] = True
            if found.any():
                sids.append(sid)
                runs.append(_runs(found))
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(runs, _RUNS)], names=["sid", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for route, sid, n, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if route != last and size > block:
                    yield work(rows)
                    rows, size = [], 0
                last = route
                rows.append((sid, n, body))
                size += len(body)
        if rows:
            yield work(rows)

    return run


# ---- the job -------------------------------------------------------------------------------------

def _key(text: Column) -> list[Column]:
    """128 bits of the text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _two(raw: bytes) -> tuple[int, int]:
    d = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def marked(docs: DataFrame, length: int) -> DataFrame:
    """Per text: its key, and the places and hashes of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, hashes = [], []
            for text in batch.column(2):
                anchor, h = window_anchors(text.as_py().encode(), length)
                at = np.unique(anchor)
                places.append(at)
                hashes.append(h[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32())),
                                              pa.array(hashes, pa.list_(pa.int64()))], names=["k1", "k2", "places", "hashes"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, places array<int>, hashes array<bigint>")


def _squeeze(docs: DataFrame) -> DataFrame:
    """Texts compressed before they move."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [pack.compress(t.as_py().encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, packed binary")


def stretches(texts: DataFrame, length: int) -> DataFrame:
    """The bucket rows of ``texts`` (node, packed, places): anchor hash, 128 bits
    of the stretch, its place; the bytes only where a task sees them first."""
    import zstandard

    names = ["route", "s1", "s2", "node", "at", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for node, packed, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = unpack.decompress(packed)
                for first, last, route in zip(*(x.tolist() for x in stretches_of(raw, np.array(places), length))):
                    body = raw[first:last + length]
                    two = _two(body)
                    fresh = two not in seen
                    if fresh:
                        seen.add(two)
                    for col, value in zip(cols, (route, *two, node, first, body if fresh else None)):
                        col.append(value)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                    cols = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return texts.select("node", "packed", "places").mapInArrow(run, "route bigint, s1 bigint, s2 bigint, node bigint, at int, body binary")


def _hot_runs(hot: DataFrame, length: int, block: int) -> DataFrame:
    """(sid, runs) for stretches of anchors that have too many of them: single
    windows are routed by their own hash, and only those whose hash comes at two
    places are sorted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for sid, n, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for off in range(len(body) - length + 1):
                    for col, value in zip(cols, (*_two(body[off:off + length]), sid, off, n)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["w1", "w2", "sid", "off", "n"])

    every = cut(hot.select("sid", "n", "body").mapInArrow(windows, "w1 bigint, w2 bigint, sid bigint, off bigint, n bigint"), "windows")
    again = every.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("sid").alias("sid")).where(F.col("n") > 1)
    again = cut(again.withColumn("wid", F.monotonically_increasing_id()), "again")
    places = cut(every.drop("n").join(again.select("w1", "w2", "wid", F.col("sid").alias("from_sid"), F.col("n").alias("total")), ["w1", "w2"]), "places")
    one = places.where(F.col("sid") == F.col("from_sid")).groupBy("wid", "w1", "sid", "total").agg(F.min("off").alias("off"))
    bodies = one.join(hot.select("sid", "body"), "sid").select(
        F.col("w1").alias("route"), F.col("wid").alias("sid"), F.col("total").alias("n"),
        F.col("body").substr((F.col("off") + 1).cast("int"), F.lit(length)).alias("body"))
    confirmed = _sort(bodies, length, block).select(F.col("sid").alias("wid"))
    found = places.join(cut(confirmed, "confirmed"), "wid").select("sid", F.col("off").cast("int").alias("off"))
    return found.groupBy("sid").agg(F.transform(F.collect_set("off"), lambda o: F.struct(o.alias("first"), o.alias("last"))).alias("runs"))


def _sort(strings: DataFrame, length: int, block: int) -> DataFrame:
    n = max(1, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = strings.select("route", "sid", "n", "body").repartition(n, "route").sortWithinPartitions("route")
    return dealt.mapInArrow(_sorted_buckets(length, block), "sid bigint, runs array<struct<first:int,last:int>>")


def removals(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``docs``: k1, k2, text (never null).  (texts: node, k1, k2, packed; windows
    that repeat: node, runs of first and last), for the texts that have any."""
    marks = cut(marked(docs, length), "marks")
    pairs = F.arrays_zip(F.col("places").alias("place"), F.col("hashes").alias("hash"))
    single = marks.select("k1", "k2", F.explode(pairs).alias("x")).select("k1", "k2", "x.place", "x.hash")
    where = F.xxhash64("k1", "k2", "place")
    many = single.groupBy("hash").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where(F.col("lo") != F.col("hi"))
    shared = single.join(cut(many.select("hash"), "shared"), "hash", "left_semi")
    spots = shared.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    bodies = _squeeze(docs).groupBy("k1", "k2").agg(F.first("packed").alias("packed"))
    texts = cut(bodies.join(spots, ["k1", "k2"]).withColumn("node", F.monotonically_increasing_id()), "texts")
    rows = cut(stretches(texts, length), "stretches")
    strings = rows.groupBy("route", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.max("body").alias("body"))
    strings = cut(strings.withColumn("sid", F.monotonically_increasing_id()), "strings")
    crowded = cut(strings.groupBy("route").count().where(F.col("count") > hot).select("route"), "crowded")
    if crowded.isEmpty():
        found = _sort(strings, length, block)
    else:
        found = _sort(strings.join(crowded, "route", "left_anti"), length, block).unionByName(
            _hot_runs(cut(strings.join(crowded, "route", "left_semi"), "hot"), length, block))
    named = cut(strings.select("sid", "route", "s1", "s2").join(cut(found, "found"), "sid").drop("sid"), "named")
    back = rows.select("route", "s1", "s2", "node", "at").join(named, ["route", "s1", "s2"])
    lists = back.groupBy("node").agg(F.flatten(F.collect_list(F.transform("runs", lambda r: F.struct(
        (r["first"] + F.col("at")).alias("first"), (r["last"] + F.col("at")).alias("last"))))).alias("runs"))
    return texts.select("node", "k1", "k2", "packed"), cut(lists, "runs")


def covered(size: int, runs: list[dict[str, int]], length: int) -> np.ndarray:
    """Which bytes the windows in ``runs`` cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, [r["first"] for r in runs], 1)
    np.add.at(change, [r["last"] + length for r in runs], -1)
    return np.cumsum(change[:-1]) > 0


def cleaned(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) of the distinct texts that repeats in
    other texts, or inside them, have shortened; kept is UTF-8 bytes, which need
    not be valid text."""
    import zstandard

    texts, runs = removals(docs, length, hot, block)
    names = ["k1", "k2", "n_removed", "n_spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for k1, k2, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = np.frombuffer(unpack.decompress(packed), np.uint8)
                gone = covered(len(raw), spans, length)
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for col, value in zip(cols, (k1, k2, int(gone.sum()), starts, raw[~gone].tobytes())):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    both = texts.join(runs, "node").select("k1", "k2", "packed", "runs")
    return both.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *_key(F.col("text")))
    short = cut(cleaned(keyed.drop("doc_id"), length, hot, block).select(
        "k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256")), "short")
    rows = keyed.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("own_sha256"))
    rows = cut(rows, "rows")
    copies = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    # one row per distinct text that is a copy or was shortened
    info = cut(copies.join(short, ["k1", "k2"], "full"), "info")
    out = rows.join(info, ["k1", "k2"], "left")
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= length)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("cut_sha256", "own_sha256")).alias("kept_sha256"))

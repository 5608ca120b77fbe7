"""Best-fit packing of tokenised documents by bin completion.

Tasks tokenise documents into pieces of at most ``cap`` tokens.  Packing needs
the lengths only: their histogram (at most ``cap`` numbers, at any corpus size)
goes to the driver, where bin completion finds the fillings.  The largest length
left is completed by undominated sets of smaller ones, least waste first; a
filling is used as often as its lengths last; branches whose waste cannot beat
the incumbent are cut; the best-fit packing is the first incumbent.  Pieces get
their place by their rank among the pieces of their length, from a
range-partitioned scan that splits a length which many pieces share.

Defined cases: a null or empty text is the single end token; a repeated row is
packed as often as it comes; null ids are kept; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import cut, shuffle_partitions

CAP = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
LONG_TEXT = 1_000_000  # characters from which the tokenizers library does the work: its merging is not quadratic
_READY: dict[str, object] = {}


def _place(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(tokenizer: str = TOKENIZER):
    """text -> little-endian uint32 ids, as ``tokenizers`` gives for the file.

    The file's vocabulary runs in tiktoken, several times as fast with the same
    ids (tested against tokenizers).  A text that holds the content of one of the
    file's added tokens goes to tokenizers, which gives that token's id."""
    if tokenizer not in _READY:
        import tiktoken
        from tokenizers import Tokenizer

        place = _place(tokenizer)
        with open(place, encoding="utf-8") as f:
            made = json.load(f)
        model, added = made["model"], [t["content"] for t in made.get("added_tokens", [])]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(place)
        odd = re.compile(r"\s{2000}|\S{2000}")  # long runs: slow or too deep for the fast one

        def encode(text: str) -> np.ndarray:
            if len(text) >= LONG_TEXT or any(t in text for t in added) or (len(text) >= 2000 and odd.search(text)):
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return np.array(fast.encode_ordinary(text), dtype="<u4")

        _READY[tokenizer] = encode
    return _READY[tokenizer]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, cap: int = CAP, end_id: int = END_ID,
           keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and (with
    ``keep_ids``) ids as little-endian uint32 bytes.  A longer document is cut
    into pieces of ``cap`` tokens, the first one shorter."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        schema.add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                stop = (len(ids) - 1) % cap + 1
                start = piece = 0
                while start < len(ids):
                    raw = ids[start:stop].tobytes()
                    rows.append((at, piece, start, stop - start, zlib.crc32(raw)) + ((raw,) if keep_ids else ()))
                    start, stop, piece = stop, stop + cap, piece + 1
            cols = list(zip(*rows)) or [[]] * len(schema)
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in cols[2:5]] + [pa.array(c, pa.binary()) for c in cols[5:6]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- bin completion over a histogram of lengths ------------------------------------------------

Filling = tuple[int, ...]
Plan = list[tuple[int, Filling]]  # (times, lengths of one sequence, largest first)


def best_fit(counts: dict[int, int], cap: int) -> Plan:
    """Best-fit decreasing, with equal sequences kept as one entry and a count."""
    open_: dict[int, list[list]] = {}  # room left -> [lengths, how many]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                per = cap // size
                many, per = (left // per, per) if left >= per else (1, left)
                open_.setdefault(cap - size * per, []).append([(size,) * per, many])
                left -= many * per
                continue
            entry = open_[room][-1]
            many = min(left, entry[1])
            entry[1] -= many
            if not entry[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - size, []).append([entry[0] + (size,), many])
            left -= many
    return [(many, lengths) for group in open_.values() for lengths, many in group]


def _dominates(a: Filling, b: Filling) -> bool:
    """Whether the items of ``b`` can be put into the items of ``a``, so that
    ``a`` is never worse."""
    if len(a) > len(b) or sum(a) < sum(b):
        return False

    def put(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        return any(rooms[k] >= b[i] and put(i + 1, rooms[:k] + (rooms[k] - b[i],) + rooms[k + 1:])
                   for k in range(len(rooms)) if rooms[k] not in rooms[:k])

    return put(0, a)


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """Sequences that any packing needs: the largest of the total over ``cap``; bounds
    that count pieces over a k-th of ``cap`` (dual feasible functions); pieces over half
    plus what the others cannot put beside them; and the best-fit packing of the pieces
    over a third, which is optimal as no more than two of them fit together."""
    if not counts:
        return 0
    size = np.array(sorted(counts), np.int64)
    many = np.array([counts[s] for s in size.tolist()], np.int64)
    bounds = [int((size * many).sum()) / cap]
    for k in range(1, 33):
        times = (k + 1) * size
        value = np.where(times % cap == 0, size * k, times // cap * cap)
        bounds.append(int((value * many).sum()) / (k * cap))
    for least in sorted({*size[2 * size <= cap].tolist(), 0}):
        over, half = size > cap - least, (size <= cap - least) & (2 * size > cap)
        rest = (2 * size <= cap) & (size >= least)
        room = int((many[half] * (cap - size[half])).sum())
        bounds.append(int(many[over].sum() + many[half].sum()) + max(0, int((size * many)[rest].sum()) - room) / cap)
    bounds.append(sum(n for n, _ in best_fit({s: n for s, n in counts.items() if 3 * s > cap}, cap)))
    return max(math.ceil(x - 1e-9) for x in bounds)


def fillings(counts: dict[int, int], room: int, width: int, steps: int, spare: bool = False) -> list[Filling]:
    """Up to ``width`` undominated sets of lengths that fit ``room``, least waste first,
    out of at most ``steps`` sets, which begin with one for every possible largest length.
    Of equal waste and number, sets with larger first lengths come first, or with ``spare``
    those with larger last ones, which keeps the small pieces, as they fit in many places.

    Bit r of ``reach[i]`` says that the i smallest lengths, each as often as there are
    pieces of it, can add up to r; so the least waste is known at once, and the sets of a
    sum are listed without a dead end."""
    if counts.get(room):
        return [(room,)]  # one item that fills the room dominates all other sets
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, left, lot = reach[-1], min(counts[s], room // s), 1
        while left:
            lot = min(lot, left)
            bits |= (bits << (s * lot)) & mask
            left, lot = left - lot, lot * 2
        reach.append(bits)

    def led(i: int, total: int) -> Iterator[Filling]:
        """The sets that add up to ``total`` with sizes[i] as their largest length."""
        s = sizes[i]
        for n in range(min(counts[s], total // s), 0, -1):
            if reach[i] >> (total - s * n) & 1:
                for rest in sets(total - s * n, i):
                    yield (s,) * n + rest

    def sets(total: int, below: int) -> Iterator[Filling]:
        """The sets of the ``below`` smallest lengths that add up to ``total``, larger lengths first."""
        if not total:
            yield ()
        for i in range(min(below, bisect_right(sizes, total)) - 1, -1, -1) if total else ():
            if not reach[i + 1] >> total & 1:
                return
            yield from led(i, total)

    best: list[Filling] = []
    for total in range(room, 0, -1):
        if not reach[-1] >> total & 1:
            continue
        found: list[Filling] = []
        for i in range(bisect_right(sizes, total) - 1, -1, -1):
            if steps <= 0 or len(found) >= width and not spare or not reach[i + 1] >> total & 1:
                break
            for f in islice(led(i, total), 1):
                found.append(f)
                steps -= 1
        if len(found) < width:
            for f in sets(total, len(sizes)):
                steps -= 1
                if f not in found:
                    found.append(f)
                if steps <= 0:
                    break
        for f in sorted(found, key=lambda f: (len(f), -f[-1] if spare else [-x for x in f])):
            if len(best) < width and not any(_dominates(b, f) for b in best):
                best.append(f)
        if len(best) >= width or steps <= 0:
            break
    return best or [()]


def search(start: dict[int, int], cap: int, best: Plan, bound: int, width: int, steps: int, nodes: list[int],
           spare: bool) -> Plan:
    """Branch and bound from the incumbent ``best``: the largest length left is completed
    by each of its fillings, used as often as its lengths last; a branch ends when what it
    wastes cannot be won back.  ``nodes`` is what is left of the budget.
    Rounds allow 0, 1, 2, 4 .. choices other than the best, in the last any number."""
    fewest = sum(n for n, _ in best)
    total = sum(s * n for s, n in start.items())
    allowed = 0
    while fewest > bound and nodes[0] > 0:
        stack = [(start, 0, total, None, allowed)]  # counts left, sequences used, length left, the way here, choices left
        cut_short = False
        while stack and nodes[0] > 0 and fewest > bound:
            counts, used, left, way, choices = stack.pop()
            if not counts:
                if used < fewest:
                    fewest, best = used, []
                    while way:
                        best.append(way[0])
                        way = way[1]
                continue
            if used + -(-left // cap) >= fewest:
                continue
            nodes[0] -= len(counts) + 200
            largest = max(counts)
            rest = counts | {largest: counts[largest] - 1}
            found = fillings(rest, cap - largest, width if choices else 1, steps, spare)
            cut_short |= not choices
            for i, f in reversed([*enumerate(found)]):
                lengths = (largest, *f)
                times = min(counts[s] // lengths.count(s) for s in set(lengths))
                after = counts | {s: counts[s] - times * lengths.count(s) for s in set(lengths)}
                stack.append(({s: n for s, n in after.items() if n}, used + times, left - times * sum(lengths),
                              ((times, lengths), way), choices - (i > 0)))
        if not cut_short:
            break
        allowed = 2 * allowed or 1
    return best


def plan_bins(histogram: dict[int, int], cap: int = CAP, width: int = 3, steps: int = 400, nodes: int = 4_000_000,
              idle: int = 80) -> Plan:
    """Fewest sequences found with ``nodes`` units of work (a branching costs 200 and the
    number of lengths left; a fixed budget, so that reruns agree, some seconds at most);
    ends at once when ``lower_bound`` is met.  A quarter for each order of
    fillings goes to searches from the whole histogram, the rest to searches
    of parts: sequences whose waste adds up to a whole one, with others drawn by a
    fixed seed, are packed anew in fewer, until ``idle`` tries in a row have gained nothing.
    Every branching uses up one length at least, so a plan has at most one entry per
    length and filling."""
    start = {s: n for s, n in histogram.items() if n > 0}
    bound = lower_bound(start, cap)
    left, best = [nodes], best_fit(start, cap)
    for spare in (False, True):
        first = [nodes // 4]
        best = search(start, cap, best, bound, width, steps, first, spare)
        left[0] -= nodes // 4 - first[0]
    draw = random.Random(7)
    tries = 0
    while left[0] > 0 and tries < idle and sum(n for n, _ in best) > bound:
        tries += 1
        left[0] -= len(best) // 4 + 200
        wasteful = sorted(((cap - sum(f), draw.random(), i) for i, (_, f) in enumerate(best) if sum(f) < cap), reverse=True)
        part: dict[int, int] = {}  # entry -> how many of its sequences
        waste = 0
        for w, _, i in wasteful:
            part[i] = min(best[i][0], -(-(cap - waste) // w))
            waste += part[i] * w
            if waste >= cap:
                break
        mixed = sorted(range(len(best)), key=lambda i: -len(best[i][1]))[:64]  # many small pieces: they fit in many ways
        for i in {*draw.sample(range(len(best)), min(len(best), draw.choice((2, 4, 8)))),
                  *draw.sample(mixed, min(len(mixed), draw.choice((2, 4, 8, 16))))}:
            part.setdefault(i, min(best[i][0], 2))
        counts: dict[int, int] = {}
        for i, n in part.items():
            for s in best[i][1]:
                counts[s] = counts.get(s, 0) + n
        now = [(n, best[i][1]) for i, n in part.items()]
        spent = min(left[0], 20 * (len(counts) + 200))
        budget = [spent]
        new = search(counts, cap, now, lower_bound(counts, cap), width, steps, budget, draw.random() < 0.5)
        left[0] -= spent - budget[0]
        if sum(n for n, _ in new) < sum(n for n, _ in now):
            tries = 0
            best = [(n - part.get(i, 0), f) for i, (n, f) in enumerate(best) if n > part.get(i, 0)] + new
    return best


def places(plan: Plan) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces per sequence, first sequence, first offset)."""
    rows: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            per = lengths.count(size)
            first = next_rank.get(size, 0)
            rows.setdefault(size, []).append((first, per, sequence, offset))
            next_rank[size] = first + per * times
            offset += per * size
        sequence += times
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


def pack(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """``parts`` (with ``length``, all else is carried) plus sequence_id and offset."""
    spark = parts.sparkSession
    kept = cut(parts.withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    ranged = kept.repartitionByRange(shuffle_partitions(spark), "length", "_rid").sortWithinPartitions("length", "_rid")
    scan = cut(ranged.drop("_rid").withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    scan = scan.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    # at most one row per task and length that begins in it: tasks + cap rows
    runs = scan.groupBy("_pid", "length").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = runs.collect()
    histogram: dict[int, int] = {}
    for r in rows:
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["_n"]
    table = places(plan_bins(histogram, cap))
    before: dict[tuple[int, int], int] = {}
    so_far: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: r["_pid"]):
        before[r["_pid"], r["length"]] = so_far.get(r["length"], 0) - r["_first"]
        so_far[r["length"]] = so_far.get(r["length"], 0) + r["_n"]
    carried = list(parts.columns)
    schema = T.StructType([parts.schema[c] for c in carried]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, pid, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_pid", "_pos"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            edges = np.flatnonzero((np.diff(length) != 0) | (np.diff(pid) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(length)]):
                if lo == hi:
                    continue
                size, rows_ = int(length[lo]), table[int(length[lo])]
                rank = pos[lo:hi] + before[int(pid[lo]), size]
                row = rows_[np.searchsorted(rows_[:, 0], rank, side="right") - 1]
                nth = rank - row[:, 0]
                seq[lo:hi] = row[:, 2] + nth // row[:, 1]
                off[lo:hi] = row[:, 3] + nth % row[:, 1] * size
            cols = [batch.column(c) for c in carried] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "sequence_id", "offset"])

    return scan.drop("_mid").mapInArrow(place, schema)


def digest(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, keep_ids=False))

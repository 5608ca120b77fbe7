"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes (a space and the text).  Offsets where tokens of
both end cut a document into groups; an A and a B token are linked where their
byte ranges overlap; an id pair counts the documents that hold it linked.

1. ``spill``: tasks tokenise chunks of documents and radix-partition the chunk's
   pair-document records by A id into one zstd run per digit, in side-major order
   (A id, B id, document).  A run has its pairs with their document counts in small
   frames, and apart from them the documents and repeats of each pair.
2. ``merge``: all runs of a digit meet in one task, which sees one row per chunk and
   pair (the chunk has added up its documents), however frequent a pair is.  A heap
   merges the runs by A id; all pairs of an A id come together, so their counts and
   the highest of them are known there, and go straight back, frame by frame, to the
   runs they came from.  A task holds compressed runs and one open frame a run.
3. ``gather``: a chunk's runs and their answers meet and are added up by document.

Tokenising is done once per distinct unit of a chunk.  A unit is a stretch from a
space to the next space that follows a character other than white space.  Neither
tokenizer has a token across such a border (A's pattern breaks there, no piece of B
has a space after another character), so encoding the units one by one or many in a
row gives the ids of the whole text; tests compare with the libraries on whole texts.

Defined cases: null and empty texts, and texts whose joined tokens differ from space
and text (such as those with U+2581), have no tokens: zeros and an empty string.
Special tokens' strings are plain text.  Texts of any length are read whole; a stretch
without a border is encoded as one.  A repeated row, a null id and a repeated id are
documents of their own.  An empty table gives an empty result.  Columns but doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import cut, shuffle_partitions
from kestrel.llm.packing import _byte_of_char, _place

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 5_000_000  # characters of text after which a chunk is written: some 200 MB while it is sorted
FRAME = 4096  # pairs in a frame of a run
BLOCK = 4096  # units encoded in one call
DIGITS = 4096  # most runs of a chunk
LONG_UNIT = 1000  # characters from which a unit is encoded by itself
B_BITS = 20  # ids of B are below 2**20
TOTALS = ("n_a", "n_b", "n_groups", "n_links")
_READY: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(_place(a), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(_place(a))
        self.slow.encode_special_tokens = True  # their strings in a text are plain text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=_place(b))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_b.append(b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else raw)
            if not self.pieces.is_byte(i) and re.search("[^▁]▁", piece):
                raise ValueError(f"{b}: piece {i} has a space after another character; units would not be independent")
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.shown = np.array([f"{i}{end}".encode() for end in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.shown_size = np.array([len(x) for x in self.shown], np.int64)

    def ids(self, text: str, long: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that begins with a space; None if their bytes differ from it."""
        if long:  # long runs are slow or too deep for the fast one
            a = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        else:
            a = np.array(self.fast.encode_ordinary(text), np.int64)
        b = np.array(self.pieces.encode(text[1:]) or [self.pieces.piece_to_id("▁")], np.int64)  # a text's last space
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> dict:
        """``borders``: the byte offsets where the units end.  Totals and group texts
        per unit, and the links with their units."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)  # one link per stretch between neighbouring ends
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        out = {n: np.diff(np.searchsorted(x, borders, "right"), prepend=0)
               for n, x in zip(TOTALS, (end_a, end_b, both, ends))}
        out["unit"] = np.searchsorted(borders, ends)
        out["key"] = (a[np.searchsorted(end_a, ends)] << B_BITS) | b[np.searchsorted(end_b, ends)]
        group = np.concatenate([np.searchsorted(both, end_a) * 2, np.searchsorted(both, end_b) * 2 + 1])
        order = np.argsort(group, kind="stable")
        place, ids = group[order], np.concatenate([a, b])[order]
        last = np.append(place[1:] != place[:-1], True)
        shown = ids + np.where(last, 1 + (place & 1), 0) * (len(self.shown) // 3)
        text = b"".join(self.shown[shown].tolist())
        tokens = np.cumsum(out["n_a"] + out["n_b"])
        stops = np.append(0, np.cumsum(self.shown_size[shown]))[tokens]
        out["text"] = [text[lo:hi] for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist())]
        return out


def aligner(a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> Aligner:
    if (a, b) not in _READY:
        _READY[a, b] = Aligner(a, b)
    return _READY[a, b]


BORDER, BLURRED = re.compile(r"(?<=\S)\x20"), re.compile(r"\s\x20")


def units(text: str) -> list[str]:
    """The units of a space and the text, each without its first space."""
    if text[0] == " " or BLURRED.search(text):
        return BORDER.split(text)
    return text.split(" ")


class Units:
    """The distinct units of a chunk, aligned: totals, group text and links of each."""

    def __init__(self, known: Aligner, names: list[str]) -> None:
        n = len(names)
        self.totals = {k: np.zeros(n, np.int64) for k in TOTALS}
        self.ok = np.ones(n, bool)
        self.text: list[bytes] = [b""] * n
        found_units, found_keys = [], []

        def take(numbers: list[int], long: bool) -> None:
            whole = [" " + names[i] for i in numbers]
            ids = known.ids("".join(whole), long)
            if ids is None:
                if len(numbers) == 1:
                    self.ok[numbers[0]] = False
                else:
                    for i in numbers:
                        take([i], long)
                return
            at = np.array(numbers, np.int64)
            got = known.align(*ids, np.cumsum([len(x.encode()) for x in whole]))
            for k in TOTALS:
                self.totals[k][at] = got[k]
            for i, text in zip(numbers, got["text"]):
                self.text[i] = text
            found_units.append(at[got["unit"]])
            found_keys.append(got["key"])

        block: list[int] = []
        for i, name in enumerate(names):
            if len(name) >= LONG_UNIT or not name or name[0].isspace() or name[-1].isspace():
                take([i], len(name) >= LONG_UNIT)  # no clear border to a neighbour
                continue
            block.append(i)
            if len(block) == BLOCK:
                take(block, False)
                block = []
        if block:
            take(block, False)
        unit, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_units, found_keys))
        order = np.argsort(unit, kind="stable")
        self.key, self.first = key[order], np.searchsorted(unit[order], np.arange(n + 1))


def _pack(x: np.ndarray) -> bytes:
    kind = next((k for k in ("u1", "u2", "u4") if not len(x) or int(x.max()) < 1 << 8 * int(k[1])), "u8")
    return kind.encode() + zstandard.compress(x.astype("<" + kind).tobytes(), 3)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[2:]), "<" + raw[:2].decode()).astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .., one after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) if len(size) else np.zeros(0, np.int64)


def _runs(known: Units, rows: list[np.ndarray], digits: int, frame: int) -> Iterator[tuple[int, list[bytes], bytes, bytes, bytes]]:
    """The chunk's records as runs: digit, frames, documents per pair, documents, repeats."""
    sizes = np.array([len(r) for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    n_units = len(known.text)
    code, times = np.unique(doc * max(n_units, 1) + (np.concatenate(rows) if rows else doc), return_counts=True)
    doc, unit = code // max(n_units, 1), code % max(n_units, 1)
    size = np.diff(known.first)[unit]
    key = known.key[_ranges(known.first[unit], size)]
    a = key >> B_BITS
    pairs, pair = np.unique((a % digits) << 48 | key, return_inverse=True)  # digit, then side-major
    record = pair * max(len(rows), 1) + np.repeat(doc, size)
    order = np.argsort(record, kind="stable")
    record, weight = record[order], np.repeat(times, size)[order]
    starts = np.flatnonzero(np.append(True, record[1:] != record[:-1])) if len(record) else np.zeros(0, np.int64)
    repeats = np.add.reduceat(weight, starts) if len(starts) else starts
    pair, doc = record[starts] // max(len(rows), 1), record[starts] % max(len(rows), 1)
    held = np.bincount(pair, minlength=len(pairs))
    ends = np.cumsum(held)
    for digit in np.unique(pairs >> 48).tolist():
        lo, hi = np.searchsorted(pairs, [digit << 48, (digit + 1) << 48])
        key = pairs[lo:hi] & ((1 << 48) - 1)
        frames = []
        for at in range(0, hi - lo, frame):
            k = key[at:at + frame]
            frames.append([_pack(k >> B_BITS), _pack(k & ((1 << B_BITS) - 1)), _pack(held[lo + at:min(hi, lo + at + frame)])])
        first, last = (ends[lo - 1] if lo else 0), ends[hi - 1]
        yield digit, [x for f in frames for x in f], _pack(held[lo:hi]), _pack(doc[first:last]), _pack(repeats[first:last])


def spill(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, chunk: int = CHUNK, frame: int = FRAME,
          digits: int | None = None) -> DataFrame:
    """Rows of two kinds: a document's (digit null) and a run's (doc_id null, digit set)."""
    digits = digits or min(DIGITS, 4 * shuffle_partitions(docs.sparkSession))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("digit", T.IntegerType()),
                           T.StructField("frames", T.ArrayType(T.BinaryType())), T.StructField("held", T.BinaryType()),
                           T.StructField("docs", T.BinaryType()), T.StructField("repeats", T.BinaryType()),
                           T.StructField("place", T.IntegerType()), T.StructField("doc_id", id_type),
                           *[T.StructField(n, T.LongType()) for n in TOTALS], T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a, b)
        number = TaskContext.get().partitionId() << 32
        names: dict[str, int] = {}
        rows: list[np.ndarray] = []
        ids: list[pa.Array] = []
        chars = 0

        def written() -> Iterator[pa.RecordBatch]:
            made = Units(known, list(names))
            fit = [bool(len(r)) and bool(made.ok[r].all()) for r in rows]
            kept = [r if ok else r[:0] for r, ok in zip(rows, fit)]
            totals = {n: [int(x[r].sum()) for r in kept] for n, x in made.totals.items()}
            shown = [hashlib.sha256(b"".join(map(made.text.__getitem__, r.tolist()))[:-1]).hexdigest() if ok else ""
                     for r, ok in zip(kept, fit)]
            n = len(kept)
            cols = {"chunk": pa.array([number] * n, pa.int64()), "place": pa.array(range(n), pa.int32()),
                    "doc_id": pa.concat_arrays(ids), "groups_sha256": pa.array(shown, pa.string()),
                    **{k: pa.array(v, pa.int64()) for k, v in totals.items()}}
            yield _batch(schema, cols, n, ids[0].type)
            for digit, frames, held, docs_, repeats in _runs(made, kept, digits, frame):
                yield _batch(schema, {
                    "chunk": pa.array([number], pa.int64()), "digit": pa.array([digit], pa.int32()),
                    "frames": pa.array([frames], pa.list_(pa.binary())), "held": pa.array([held], pa.binary()),
                    "docs": pa.array([docs_], pa.binary()), "repeats": pa.array([repeats], pa.binary())}, 1, ids[0].type)

        for batch in batches:
            for at, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                words = units(text) if text else []
                rows.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
                ids.append(batch.column(0).slice(at, 1))
                chars += len(text) + 8
                if chars >= chunk:
                    yield from written()
                    names.clear(), rows.clear(), ids.clear()
                    number, chars = number + 1, 0
        if rows:
            yield from written()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _batch(schema: T.StructType, cols: dict[str, pa.Array], n: int, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "digit": pa.int32(), "frames": pa.list_(pa.binary()), "place": pa.int32(), "doc_id": id_type,
             "groups_sha256": pa.string(), **{k: pa.int64() for k in TOTALS}}
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, kinds.get(c, pa.binary())) for c in schema.names],
                                      names=schema.names)


class Run:
    """One run in the merge: its groups by A id, and the answers to its open frame."""

    def __init__(self, chunk: int, digit: int, frames: list[bytes]) -> None:
        self.chunk, self.digit, self.frames = chunk, digit, frames
        self.frame = self.done = 0
        self.answers: list[tuple[np.ndarray, np.ndarray]] = []
        self._open()

    def _open(self) -> None:
        self.at = 0
        self.a = None
        if self.frame < len(self.frames):
            self.a, self.b, self.n = (_unpack(x) for x in self.frames[self.frame:self.frame + 3])
            self.frames[self.frame:self.frame + 3] = [b"", b"", b""]

    @property
    def head(self) -> int | None:
        return None if self.a is None else int(self.a[self.at])

    def group(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the A id at the head, which may go on in the next frames."""
        own, parts = self.head, []
        while self.a is not None and self.a[self.at] == own:
            stop = int(np.searchsorted(self.a, own, "right"))
            parts.append((self.b[self.at:stop], self.n[self.at:stop]))
            self.at = stop
            if stop == len(self.a):
                self.frame += 3
                self._open()
        return (parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts)))

    def answer(self, counts: np.ndarray, best: np.ndarray, last: bool, frame: int) -> Iterator[tuple]:
        """A row to send back once a frame is full."""
        self.answers.append((counts, best))
        if last or sum(len(c) for c, _ in self.answers) >= frame:
            counts, best = (np.concatenate(x) for x in zip(*self.answers))
            yield self.chunk, self.digit, self.done, _pack(counts), _pack(best)
            self.done, self.answers = self.done + 1, []


def merged(runs: list[Run], frame: int) -> Iterator[tuple]:
    """A heap brings the A ids in order, each with the runs that hold it."""
    heap = [(r.head, i) for i, r in enumerate(runs) if r.head is not None]
    heapq.heapify(heap)
    while heap:
        own, members = heap[0][0], []
        while heap and heap[0][0] == own:
            members.append(heapq.heappop(heap)[1])
        groups = [runs[i].group() for i in members]
        if len(groups) == 1:
            counts = [groups[0][1]]
        else:
            _, place = np.unique(np.concatenate([b for b, _ in groups]), return_inverse=True)
            total = np.zeros(int(place.max()) + 1, np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in groups]))
            counts = np.split(total[place], np.cumsum([len(b) for b, _ in groups])[:-1])
        most = max(int(c.max()) for c in counts)
        for i, c in zip(members, counts):
            last = runs[i].head is None
            yield from runs[i].answer(c, c == most, last, frame)
            if not last:
                heapq.heappush(heap, (runs[i].head, i))


def merge(spilled: DataFrame, frame: int = FRAME) -> DataFrame:
    """The answers to all runs: chunk, digit, number of the part, count per pair and
    whether it is the highest of its A id."""
    schema = "chunk long, digit int, part int, counts binary, best binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            digit, runs = None, []
            for batch in batches:
                for x in batch.to_pylist():
                    if x["digit"] != digit:
                        yield from merged(runs, frame)
                        digit, runs = x["digit"], []
                    runs.append(Run(x["chunk"], x["digit"], x["frames"]))
            yield from merged(runs, frame)

        names = ["chunk", "digit", "part", "counts", "best"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        held: list[tuple] = []
        for row in rows():
            held.append(row)
            if len(held) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    runs = spilled.where("digit IS NOT NULL").select("chunk", "digit", "frames")
    return (runs.repartition(shuffle_partitions(spilled.sparkSession), "digit")
            .sortWithinPartitions("digit", "chunk").mapInArrow(run, schema))


def gather(spilled: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per document.  A group is one chunk, of bounded size."""
    id_type = spilled.schema["doc_id"].dataType
    names = ["doc_id", *TOTALS, "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in names[1:-1]],
                           T.StructField("groups_sha256", T.StringType())])

    def add(mine: pa.Table, sent: pa.Table) -> pa.Table:
        is_doc = pa.compute.is_null(mine["digit"])
        docs = mine.filter(is_doc).sort_by("place")
        best_of, sum_of = (np.zeros(len(docs), np.int64) for _ in range(2))
        back: dict[int, list[tuple]] = {}
        for x in sent.to_pylist():
            back.setdefault(x["digit"], []).append((x["part"], x["counts"], x["best"]))
        for x in mine.filter(pa.compute.invert(is_doc)).select(["digit", "held", "docs", "repeats"]).to_pylist():
            parts = sorted(back[x["digit"]])
            held, doc, times = (_unpack(x[c]) for c in ("held", "docs", "repeats"))
            counts, best = (np.repeat(np.concatenate([_unpack(p[i]) for p in parts]), held) for i in (1, 2))
            np.add.at(sum_of, doc, counts * times)
            np.add.at(best_of, doc, best * times)
        cols = [docs[c].combine_chunks() if c in docs.column_names else pa.array(best_of if c == "n_best" else sum_of) for c in names]
        return pa.Table.from_arrays(cols, names=names)

    mine = spilled.drop("frames")
    return mine.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, schema)


def digest(docs: DataFrame) -> DataFrame:
    spilled = cut(spill(docs), "runs")
    return gather(spilled, merge(spilled))

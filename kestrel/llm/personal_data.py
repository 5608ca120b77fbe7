"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: the base patterns, and
looser forms (addresses with the sign spelt out, IPv6, any run of digits with
separators as phone or card).  Boosted trees score each candidate by its format and
the words before it; a threshold per kind, calibrated on candidates that were not
trained on, selects what is added to the base spans, which always stay.

Nobody has marked personal data in the corpus, so labels are weak: a candidate that
is a base span is 1; another one that passes its kind's check (Luhn, octets, number
of digits, a domain) and has a cue word of its kind before it is 1; all others are 0.
A quarter of the candidates, by the CRC-32 of their text, is kept for calibration.
About ``SAMPLE`` labelled candidates train the trees, chosen by hash where there are
more; candidates, scores, thresholds and spans cover all texts.

Positions are code points, the end exclusive.  Every pattern is matched in time that
grows with the length of the text: an address is found from its sign, to the left up
to the match before.  Defined cases: a null text is the empty text and has no spans;
texts of any length are read whole; a repeated row or null id gets its own row; where
no candidate or one class only is known no span is added; ties in score go to the
earlier, then longer span; an empty table gives an empty result.  Columns but doc_id
and text are not read (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import boxed, cut, unboxed

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE = 200_000  # labelled candidates that train, where there are more
ROUNDS, DEPTH, SEED = 20, 4, 11
PRECISION = 0.98  # of the candidates above a kind's threshold, on those kept for calibration
BINS = 1000

Base = tuple[int, int, int]  # start, kind, stop

# fixed values: the contract's patterns.  The address is matched from its sign on; a run of digits
# that follows a digit cannot begin a match that the run itself does not, so it is left out.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# looser forms
SPELT = re.compile(r"[\x20\[({<]{1,2}(?:at|AT|@)[\x20\])}>]{1,2}")
SPELT_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[\x20\[({<]{1,2}(?:dot|DOT|\.)[\x20\])}>]{1,2}|\.)[A-Za-z0-9-]{1,63}){1,8}")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,3}+[0-9])++")
CUES = tuple(re.compile(x, re.I) for x in (
    r"mail|contact|kontakt|courriel|correo|write to|escrib|schreib",
    r"\bip\b|server|host|address|adresse|direcci|node|client",
    r"card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit|cr[eé]dito|\bpan\b",
    r"tel\b|tel[.:]|phone|fon\b|call|mobile|mobil|handy|fax|appel|llam|whatsapp|anruf"))
BEFORE = 48  # code points of context


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(x: str) -> str:
    return re.sub(r"[^0-9]", "", x)


def _quads(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in QUAD.finditer(text):
        yield m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))


def _local(text: str, at: int, floor: int) -> int:
    """Where the local part that ends at ``at`` begins, at ``floor`` or later."""
    step = 64
    while True:
        lo = max(floor, at - step)
        part = text[lo:at]
        size = LOCAL.match(part[::-1]).end()
        if size < len(part) or lo == floor:
            return at - size
        step *= 4


def base_spans(text: str) -> list[Base]:
    """The base spans by start, then kind."""
    out: list[Base] = []
    floor = 0
    for m in HOST.finditer(text):
        start = _local(text, m.start(), floor)
        if start < m.start():
            out.append((start, EMAIL, m.end()))
            floor = m.end()
    out += [(a, IP, b) for a, b, good in _quads(text) if good]
    out += [(m.start(), CARD, m.end()) for m in DIGITS.finditer(text)
            if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in DIALLED.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
    return sorted(out)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def generated(text: str, base: list[Base]) -> list[tuple[int, int, int, bool]]:
    """Candidates (start, stop, kind, passes its kind's check), base spans among them."""
    found = {(a, b, k): True for a, k, b in base}
    for a, b, good in _quads(text):
        found.setdefault((a, b, IP), good)
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        d = _only_digits(m[0])
        if 7 <= len(d) <= 15:
            found.setdefault((m.start(), m.end(), PHONE), 9 <= len(d))
        if 12 <= len(d) <= 19:
            start = m.start() + (m[0][0] in "+(")
            found.setdefault((start, m.end(), CARD), 13 <= len(d) and luhn(d))
    for m in SPELT.finditer(text):
        start, host = _local(text, m.start(), max(0, m.start() - 64)), SPELT_HOST.match(text, m.end())
        if start < m.start() and host:
            found.setdefault((start, host.end(), EMAIL), bool(re.search(r"[A-Za-z]{2,24}$", host[0])))
    if COLONS.search(text):
        for m in SIX.finditer(text):
            if m[0].count(":") >= 2 and re.search(r"[0-9A-Fa-f]", m[0]):
                try:
                    ipaddress.IPv6Address(m[0])
                    found.setdefault((m.start(), m.end(), IP), True)
                except ValueError:
                    found.setdefault((m.start(), m.end(), IP), False)
    return sorted((a, b, k, good) for (a, b, k), good in found.items())


def features(text: str, start: int, stop: int, kind: int, good: bool) -> list[float]:
    span, before = text[start:stop], text[max(0, start - BEFORE):start]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    cues = [len(c.findall(before)) for c in CUES]
    return [float(x) for x in (
        kind, len(span), len(digits), len(set(digits)), len(groups), len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0, max(map(len, groups), default=0), span[0] == "+" or digits[:2] == "00",
        "(" in span, span.count("-"), span.count("."), span.count(" "), span.count("/"), span.count(":"), good,
        luhn(digits) if 0 < len(digits) < 40 else 0, sum(c.isalpha() for c in span), "@" in span,
        _class(text[start - 1:start]), _class(text[stop:stop + 1]), cues[kind], sum(cues) - cues[kind],
        before.rstrip()[-1:] in (":", "="), before.rstrip(" :=(")[-1:].isalpha())]


N_FEATURES, CUED = 25, 21  # how many, and which one counts the cues of the candidate's own kind
Candidate = tuple[int, int, int, int, bool, list[float]]  # start, stop, kind, label, kept for calibration, features


class Taken:
    """Disjoint stretches in order: the union of the spans given."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        for start, stop in sorted(spans):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(stop, self.stops[-1])
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def meets(self, start: int, stop: int) -> bool:
        at = bisect_left(self.starts, stop) - 1
        return at >= 0 and self.stops[at] > start

    def add(self, start: int, stop: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.stops.insert(at, stop)


def candidates(text: str, base: list[Base]) -> list[Candidate]:
    out, marked, taken = [], {(a, b, k) for a, k, b in base}, Taken([(a, b) for a, _, b in base])
    if not (re.search("[0-9]", text) or SPELT.search(text) or COLONS.search(text) or base):
        return out
    for start, stop, kind, good in generated(text, base):
        x = features(text, start, stop, kind, good)
        own = (start, stop, kind) in marked
        label = int(own or (good and x[CUED] > 0 and not taken.meets(start, stop)))
        out.append((start, stop, kind, label, zlib.crc32(text[start:stop].encode()) % 4 == 0, x))
    return out


@dataclass(frozen=True)
class Forest:
    """Boosted trees: per node the feature, the bound and the children; leaves have feature -1."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, bound, low, high), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go_low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= bound[at]
                at = np.where(inner, np.where(go_low, low[at], high[at]), at)
            total += weight * bound[at]
        return 1 / (1 + np.exp(-2 * total))

    def chosen(self, base: list[Base], found: list) -> list[Base]:
        """The base spans and the candidates above their kind's threshold, none of which
        overlaps another or a base span."""
        own = set(base)
        rest = [c for c in found if (c[0], c[2], c[1]) not in own]
        if not rest or not self.trees:
            return sorted(base)
        score = self.scores(np.array([c[5] for c in rest], np.float64))
        taken, out = Taken([(a, b) for a, _, b in base]), list(base)
        ranked = sorted((-s, c[0], -c[1], c[2]) for s, c in zip(score.tolist(), rest) if s >= self.thresholds[c[2]])
        for _, start, stop, kind in ranked:
            if not taken.meets(start, -stop):
                taken.add(start, -stop)
                out.append((start, kind, -stop))
        return sorted(out)


def parsed(described: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as Spark ML describes it, as arrays."""
    feature, bound, low, high = [], [], [], []
    stack: list[int] = []
    for line in described.splitlines():
        if m := re.match(r"\s*If \(feature (\d+) <= (\S+)\)", line):
            new = (int(m[1]), float(m[2]))
        elif m := re.match(r"\s*Predict: (\S+)", line):
            new = (-1, float(m[1]))
        else:
            continue  # an Else repeats its If
        at = len(feature)
        if stack:
            if low[stack[-1]] < 0:
                low[stack[-1]] = at
            else:
                high[stack.pop()] = at
        for column, value in zip((feature, bound, low, high), (*new, -1, -1)):
            column.append(value)
        if new[0] >= 0:
            stack.append(at)
    return np.array(feature), np.array(bound), np.array(low), np.array(high)


SPAN = "struct<start:bigint,kind:int,stop:bigint>"
FOUND = "struct<start:bigint,stop:bigint,kind:int,label:int,held:boolean,x:array<double>>"
_ARROW_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
_ARROW_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("label", pa.int32()),
                                   ("held", pa.bool_()), ("x", pa.list_(pa.float64()))]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found), a row per document."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"base array<{SPAN}>, found array<{FOUND}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, founds = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": a, "kind": k, "stop": b} for a, k, b in base])
                founds.append([dict(zip(("start", "stop", "kind", "label", "held", "x"), c)) for c in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _ARROW_BASE), pa.array(founds, _ARROW_FOUND)],
                                             names=["doc_id", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fit(scanned: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees on the candidates that are not held out, thresholds on those that are."""
    found = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.start", "c.label", "c.kind", "c.held", "c.x")
    sizes = {(r["held"], r["label"]): r["n"] for r in found.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(sizes.get((False, y)) for y in (0, 1)):
        return Forest((), ())
    share = sample / (sizes[False, 0] + sizes[False, 1])
    train = found.where("NOT held")
    if share < 1:
        train = train.where(F.pmod(F.xxhash64("doc_id", "start", "kind", "x"), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = cut(train.select(F.col("label").cast("double").alias("y"), "x"), "candidates")
    rows = train.select("y", array_to_vector("x").alias("v"))
    model = GBTClassifier(labelCol="y", featuresCol="v", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(rows)
    forest = Forest(tuple(parsed(t.toDebugString) for t in model.trees), tuple(model.treeWeights))
    return Forest(forest.trees, forest.weights, calibrated(found.where("held"), forest))


def calibrated(held: DataFrame, forest: Forest) -> tuple[float, ...]:
    """Per kind the least score from which on at least ``PRECISION`` of the held-out
    candidates are 1; never under a half, and out of reach where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten()).reshape(-1, N_FEATURES)
            bins = np.minimum((forest.scores(x) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.int32())], names=["kind", "label", "bin"])

    scored = held.select("kind", "label", "x").mapInArrow(run, "kind int, label int, bin int")
    counts = np.zeros((len(KINDS), 2, BINS), np.int64)  # kinds x labels x bins numbers, at any corpus size
    for r in scored.groupBy("kind", "label", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["kind"], r["label"], r["bin"]] = r["n"]
    above = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
    out = []
    for no, yes in above:
        good = (yes >= PRECISION * (yes + no)) & (yes > 0) & (np.arange(BINS) >= BINS // 2)
        out.append(float(np.flatnonzero(good)[0]) / BINS if good.any() else 2.0)
    return tuple(out)


def shown(spans: list[Base]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    scanned = cut(scan(docs), "personal")
    forest = fit(scanned)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [[] for _ in KINDS], [], []
            for own, found in zip(batch.column(1), batch.column(2)):
                base = [(s["start"], s["kind"], s["stop"]) for s in own.as_py()]
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(forest.chosen(base, [tuple(c.values()) for c in found.as_py()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                                              pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return scanned.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", forest: Forest | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``, overlapping ones by the first's
    kind; other rows and columns stay."""
    if forest is None:
        forest = fit(cut(scan(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))), "personal"))

    @F.pandas_udf("string")
    def clean(values):
        def one(value):
            if not value:
                return value
            base = base_spans(value)
            out, at = [], 0
            for start, kind, stop in forest.chosen(base, candidates(value, base)):
                if start >= at:
                    out += [value[at:start], f"[{KINDS[kind]}]"]
                at = max(at, stop)
            return "".join([*out, value[at:]])

        return values.map(one, na_action="ignore")

    rows = boxed(docs)
    return unboxed(rows.select(F.col("_row").withField(f"`{text}`", clean(F.col(f"_row.`{text}`"))).alias("_row")))

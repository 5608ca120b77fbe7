"""Multilingual mixture inference for language ID.

Each language has a distribution over hashed letter trigrams of its words.  A
document is a mixture: every word is drawn from one of the languages, and
expectation-maximisation estimates the proportions.  The language set is the one
with the best penalised likelihood, of sets of any size that take the languages by
their share and whose last one has a word's worth; the predicted language is its
largest part.

Defined cases: a text that is null or has no letters is ``und`` with score 0, so
is every text when there is nothing to learn from; repeated rows get equal
results; an empty table gives an empty result; columns but doc_id, text and lang
are not read.  Texts are read whole, in blocks of documents of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import fold, held_out

BITS = 14  # hashed trigrams
SMOOTH = 0.5
BLOCK = 500_000  # characters worked on at once; a longer document is a block of its own
ROUNDS = 10
MAX_LANGUAGES = 1000  # distinct values of ``lang``; more is an error, not a cut


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, lower-case texts) with about BLOCK characters each."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        if part and size + len(text) > BLOCK:
            yield first, part
            first, part, size = i, [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield first, part


def trigrams(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the trigram around each letter, the index where each word begins
    among them, and each word's text.  Neighbours that are no letters count as 0."""
    code = np.frombuffer(("\n".join(["", *part, ""])).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in part])
    letter = _letters()[code]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(letter, code, 0).astype(np.uint32)
    before = code[at - 1]
    with np.errstate(over="ignore"):
        h = before * np.uint32(2654435761) ^ code[at] * np.uint32(2246822519) ^ code[at + 1] * np.uint32(3266489917)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(668265263)) >> np.uint32(32 - BITS)
    words = np.flatnonzero(before == 0)
    return h, words, np.searchsorted(ends, at[words], side="right")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (hash x language) from all rows given.

    Tasks add up their own counts and Spark sums them by language and hash: at
    most languages x 2^BITS rows come to the driver."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    schema = "lang string, bucket int, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in _blocks(texts):
                h, words, doc = trigrams(part)
                if not len(h):
                    continue
                of_letter = np.repeat(doc, np.diff([*words, len(h)]))
                names = langs[first:first + len(part)]
                index = {name: i for i, name in enumerate(dict.fromkeys(names))}
                lang_no = np.array([index[name] for name in names])[of_letter]
                flat = np.bincount(lang_no * (1 << BITS) + h, minlength=len(index) << BITS)
                for name, i in index.items():
                    sums[name] = sums.get(name, 0) + flat[i << BITS:(i + 1) << BITS]
        for name, total in sums.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.int32()),
                                              pa.array(total[hit], pa.int64())], names=["lang", "bucket", "n"])

    rows = known.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if (n := known.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages, over MAX_LANGUAGES={MAX_LANGUAGES}")
    got = rows.toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    counts = np.full((1 << BITS, len(names)), SMOOTH)
    if names:
        index = {x: i for i, x in enumerate(names)}
        counts[got["bucket"].to_numpy(), [index[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _mixture(like: np.ndarray, of: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from the proportions ``share``: the proportions found and the log-likelihood."""
    for _ in range(ROUNDS):
        part = like * share[of]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.add.reduceat(part, starts, axis=0) / n[:, None]
    mixed = np.log((like * share[of]).sum(axis=1) + 1e-30)
    return share, np.add.reduceat(mixed, starts)


def infer(part: list[str], model: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the language's index (-1 for none), its score, and the
    proportions in the chosen set."""
    k = model.shape[1]
    best, score, shares = np.full(len(part), -1), np.zeros(len(part)), np.zeros((len(part), k))
    h, words, doc = trigrams(part)
    if not len(h) or not k:
        return best, score, shares
    log_like = np.add.reduceat(model[h], words, axis=0).astype(np.float64)
    which, starts, n = np.unique(doc, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(which)), n)
    peak = log_like.max(axis=1, keepdims=True)
    like = np.exp(log_like - peak)
    base = np.add.reduceat(peak[:, 0], starts)
    single = np.add.reduceat(log_like, starts, axis=0)
    top = single.argmax(axis=1)
    value = single.max(axis=1)  # penalised: a set of one language has no free proportion
    chosen = np.zeros((len(which), k))
    chosen[np.arange(len(which)), top] = 1
    full, _ = _mixture(like, of, starts, n, np.full((len(which), k), 1 / k))
    rank = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        rows = np.flatnonzero(full[np.arange(len(which)), rank[:, size - 1]] * n >= 1)  # at least a word's worth
        if not len(rows):
            break
        mask = np.zeros((len(rows), k))
        np.put_along_axis(mask, rank[rows, :size], 1 / size, axis=1)
        pick = np.isin(of, rows)
        n_ = n[rows]
        starts_ = np.concatenate([[0], np.cumsum(n_)[:-1]])
        share, ll = _mixture(like[pick], np.repeat(np.arange(len(rows)), n_), starts_, n_, mask)
        gain = ll + base[rows] - penalty * (size - 1) * np.log(np.maximum(n_, 2))
        better = gain > value[rows]
        value[rows[better]] = gain[better]
        chosen[rows[better]] = share[better]
    best[which] = chosen.argmax(axis=1)
    share = full[np.arange(len(which)), best[which]]
    score[which] = (n * share + 1) / (n + k)
    shares[which] = chosen
    return best, score, shares


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and parts (the chosen set's proportions)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("parts", T.StringType())])
    labels = [*names, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score, parts = [], [], []
            for _, part in _blocks(texts):
                best, s, shares = infer(part, model)
                pred += [labels[i] for i in best]
                score += s.tolist()
                parts += [",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in shares]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(parts, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    names, model = learn(docs.where(fold(F.col("doc_id")) != 1))
    out = predict(docs, names, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "parts")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language.  The verdict on a text
    depends on the text alone, so rows are kept by one pass and no join."""
    names, model = learn(docs.where(fold(F.col("doc_id")) != 1))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [infer(part, model)[0] for _, part in _blocks(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, int), *best]) >= 0))

    return docs.mapInArrow(run, schema)

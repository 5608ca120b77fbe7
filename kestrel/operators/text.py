"""Text operators.

Column expressions wherever Spark has the function; sequential per-document
logic (sentence packing, HTML and pipe-table parsing) runs in Arrow pandas
UDFs that return ``array<struct>`` and are exploded by Spark.  Whole texts
are processed, never prefixes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kestrel.functions.scalars import any_of
from kestrel.plans.distributed import global_rank, written

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Prompt-injection / unsafe-text patterns, matched case-insensitively, first match reported.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"disregard\s+(all\s+)?previous\s+instructions?",
    r"forget\s+(all\s+)?previous\s+instructions?",
    r"override\s+(all\s+)?previous\s+instructions?",
    r"new\s+instructions?:",
    r"system\s*prompt\s*:",
    r"you\s+are\s+now\s+",
    r"pretend\s+you\s+are\s+",
    r"act\s+as\s+if\s+you\s+are\s+",
    r"roleplay\s+as\s+",
    r"your\s+new\s+role\s+is\s+",
    r"reveal\s+(your\s+)?(system\s+)?prompt",
    r"show\s+(me\s+)?(your\s+)?(system\s+)?prompt",
    r"print\s+(your\s+)?(system\s+)?prompt",
    r"display\s+(your\s+)?(system\s+)?prompt",
    r"what\s+(is|are)\s+(your\s+)?instructions?",
    r"what\s+were\s+you\s+told\s+",
    r"api\s*key",
    r"secret\s*key",
    r"password",
    r"credentials?",
    r"do\s+anything\s+now",
    r"DAN\s+mode",
    r"jailbreak",
    r"unrestricted\s+mode",
    r"developer\s+mode",
    r"no\s+restrictions?",
    r"execute\s+code",
    r"run\s+python",
    r"eval\s*\(",
    r"exec\s*\(",
    r"import\s+os",
    r"subprocess",
    r"__import__",
    r"send\s+(to|data\s+to)",
    r"http[s]?://",
    r"curl\s+",
    r"wget\s+",
]
# Sentiment lexicon.
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "nice", "love",
                  "like", "best", "better", "happy", "beautiful", "perfect", "brilliant", "outstanding", "superb",
                  "positive", "joy", "recommend", "pleased", "satisfied", "enjoy"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "horrible", "poor", "worst", "hate", "dislike", "disappointing",
                  "disappointed", "angry", "sad", "negative", "boring", "waste", "useless", "broken", "fail",
                  "failed", "problem", "issue", "wrong", "error", "bug", "annoying"]
# Chunking defaults (characters).
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 700, 150, 100
# ---------------------------------------------------------------------------

CHUNK_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("chunk_index", T.IntegerType()), T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()), T.StructField("chunk_type", T.StringType()),
    T.StructField("text", T.StringType())]))


def fixed_chunks(df: DataFrame, text: str, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters
    (``sequence`` + ``posexplode`` + ``substring``)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    e = df.select(key, text, F.posexplode(starts).alias("chunk_index", "char_start")).where(F.length(text) > 0)
    return e.select(key, "chunk_index", "char_start",
                    F.least(F.col("char_start") + size, F.length(text)).alias("char_end"),
                    F.expr(f"substring({text}, char_start + 1, {size})").alias("text"))


# fixed values: sentence bounds (end mark before a capital, end mark before a line break, paragraph break)
_SENT_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n|\n\n+")
_TABLE_LINE = re.compile(r"^\s*(\+|.*\|)|^([^,]*,){2,}")


def _sentences(text: str) -> list[tuple[int, int]]:
    spans, pos = [], 0
    for m in _SENT_SPLIT.finditer(text):
        if m.start() > pos and text[pos:m.start()].strip():
            spans.append((pos, m.start()))
        pos = m.end()
    if pos < len(text) and text[pos:].strip():
        spans.append((pos, len(text)))
    return spans


def _pack(text: str, spans: list[tuple[int, int]], size: int, min_size: int, kind: str, out: list, overlap_one: bool):
    cur: list[tuple[int, int]] = []
    for s in spans:
        if cur and s[1] - cur[0][0] > size:
            out.append((cur[0][0], cur[-1][1], kind))
            cur = [cur[-1]] if overlap_one and cur[-1][1] - cur[-1][0] < size else []
        cur.append(s)
    if cur:
        if out and out[-1][2] == kind and cur[-1][1] - cur[0][0] < min_size:
            st = out[-1][0]
            out[-1] = (st, cur[-1][1], kind)  # short tail merged into the previous chunk
        else:
            out.append((cur[0][0], cur[-1][1], kind))


def chunk_document(text: str | None, size: int = CHUNK_SIZE, min_size: int = MIN_CHUNK,
                   tables: bool = False) -> list[dict]:
    """N3/N4 for one document: sentence spans packed greedily up to ``size``
    characters with a one-sentence overlap; a short tail is merged; with
    ``tables`` blocks of table-like lines (< 500 chars each) are kept whole."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    if tables:
        blocks = []
        lines = text.split("\n")
        offs, o = [], 0
        for ln in lines:
            offs.append(o)
            o += len(ln) + 1
        i = 0
        while i < len(lines):
            is_tab = bool(_TABLE_LINE.match(lines[i])) and len(lines[i]) < 500
            j = i
            while j < len(lines) and (bool(_TABLE_LINE.match(lines[j])) and len(lines[j]) < 500) == is_tab:
                j += 1
            end = offs[j - 1] + len(lines[j - 1])
            blocks.append((offs[i], end, is_tab))
            i = j
        for st, en, is_tab in blocks:
            if is_tab:
                out.append((st, en, "table"))
            else:
                seg = text[st:en]
                _pack(text, [(st + a, st + b) for a, b in _sentences(seg)], size, min_size, "text", out, True)
    else:
        _pack(text, _sentences(text), size, min_size, "text", out, True)
    return [{"chunk_index": i, "char_start": s, "char_end": e, "chunk_type": k, "text": text[s:e]}
            for i, (s, e, k) in enumerate(out)]


def paragraph_chunks_doc(text: str | None, size: int = CHUNK_SIZE, overlap: int = 100) -> list[dict]:
    """N5 for one document: paragraphs (blank-line separated) packed up to
    ``size``; each chunk after the first is prefixed with the previous chunk's
    last ``overlap`` characters."""
    if not text:
        return []
    paras, pos = [], 0
    for m in re.finditer(r"\n\s*\n", text):
        if text[pos:m.start()].strip():
            paras.append((pos, m.start()))
        pos = m.end()
    if text[pos:].strip():
        paras.append((pos, len(text)))
    packed: list[tuple[int, int, str]] = []
    _pack(text, paras, size, 0, "paragraph", packed, False)
    res, prev = [], ""
    for i, (s, e, k) in enumerate(packed):
        body = text[s:e]
        res.append({"chunk_index": i, "char_start": s, "char_end": e, "chunk_type": k,
                     "text": (prev[-overlap:] + " " + body) if prev else body})
        prev = body
    return res


_AT_ONCE = 1 << 20  # characters whose results a task holds


def _flat(df: DataFrame, text: str, key: str, kind: T.ArrayType, fn) -> DataFrame:
    """(key, fields of ``kind``): the structs that ``fn`` makes of each text, one row each.

    A task holds the results of about ``_AT_ONCE`` characters, or of one text, not those of a whole
    Arrow batch: its memory does not follow the number of texts, and no nested list is built."""
    fields = kind.elementType.fields
    out = T.StructType([df.schema[key], *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, cols, size = [], [[] for _ in fields], 0
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                for found in fn(t):
                    rows.append(i)
                    for c, f in zip(cols, fields):
                        c.append(found[f.name])
                size += len(t or "")
                if rows and size >= _AT_ONCE:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *map(pa.array, cols, types)], names=out.names)
                    rows, cols, size = [], [[] for _ in fields], 0
            if rows:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *map(pa.array, cols, types)], names=out.names)

    return df.select(key, text).mapInArrow(run, out)


def sentence_chunks(df: DataFrame, text: str, key: str, size: int = CHUNK_SIZE, min_size: int = MIN_CHUNK,
                    tables: bool = False) -> DataFrame:
    """One row per chunk (key, chunk_index, char_start, char_end,
    chunk_type, text), made in Arrow batches of bounded size."""
    return _flat(df, text, key, CHUNK_SCHEMA, lambda t: chunk_document(t, size=size, min_size=min_size, tables=tables))


def paragraph_chunks(df: DataFrame, text: str, key: str, size: int = CHUNK_SIZE, overlap: int = 100) -> DataFrame:
    """Paragraph chunks with character overlap."""
    return _flat(df, text, key, CHUNK_SCHEMA, lambda t: paragraph_chunks_doc(t, size=size, overlap=overlap))


def chunk_stats(chunks: DataFrame, source: str) -> DataFrame:
    """Chunk count and length statistics per source."""
    ln = F.length("text")
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), F.avg(ln).alias("avg_len"),
                                      F.min(ln).alias("min_len"), F.max(ln).alias("max_len"))


def with_context(df: DataFrame, text: str, context: str, out: str = "contextual_text") -> DataFrame:
    """``[CONTEXT: ...]`` prefix; :func:`strip_context` restores the text."""
    return df.withColumn(out, F.concat(F.lit("[CONTEXT: "), F.col(context), F.lit("] "), F.col(text)))


def strip_context(c) -> Column:
    return F.regexp_replace(c, r"^\[CONTEXT: [^\]]*\] ", "")


def row_chunks(df: DataFrame, order: Sequence[str], rows_per_chunk: int = 25, source: str | None = None) -> DataFrame:
    """Table rows as ``col=value`` text (nulls skipped), 25 rows per chunk,
    rows numbered on a global range scan (one huge file never sits in one
    task); the chunk text is the header plus its rows in order."""
    cols = [c for c in df.columns if c != source]
    row_text = F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string")))
                                   for c in cols])
    base = df.select(*([source] if source else []), *order, row_text.alias("_row"))
    r = global_rank(base, [*([source] if source else []), *order], out="_rn")
    if source:
        first = r.groupBy(source).agg(F.min("_rn").alias("_r0"))
        r = r.join(first, source).withColumn("_rn", F.col("_rn") - F.col("_r0") + 1)
    r = r.withColumn("chunk_index", ((F.col("_rn") - 1) / rows_per_chunk).cast("long"))
    keys = ([source] if source else []) + ["chunk_index"]
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "_row"))).alias("_rows"),
                             F.min("_rn").alias("first_row"), F.max("_rn").alias("last_row"))
    header = F.lit("columns: " + ", ".join(cols) + "\n")
    return g.select(*keys, "first_row", "last_row",
                    F.concat(header, F.array_join(F.transform("_rows", lambda x: x["_row"]), "\n")).alias("text"))


def text_statistics(c) -> dict[str, Column]:
    """Characters, words, sentences (parts between full stops that are not
    blank, one at least), average word length, words per sentence, share of
    distinct words, shares of upper-case letters and digits, count of ``.,!?;:``
    and a reading score between 0 and 100.  An empty or null text has zeros (and
    one sentence)."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n_chars, n_words = F.length(c), F.size(words)
    n_sent = F.greatest(F.size(F.filter(F.split(c, r"\."), lambda s: F.regexp_replace(s, r"\s+", "") != "")), F.lit(1))
    letters = F.length(F.regexp_replace(c, r"\s+", ""))
    word_len = F.when(n_words > 0, letters / n_words).otherwise(F.lit(0.0))
    per_sent = n_words / n_sent
    reading = 206.835 - 1.015 * per_sent - 84.6 * (word_len / F.greatest(n_words, F.lit(1)))

    def share(pattern: str) -> Column:
        return F.when(n_chars > 0, F.length(F.regexp_replace(c, pattern, "")) / n_chars).otherwise(F.lit(0.0))

    return {
        "chars": n_chars, "words": n_words, "sentences": n_sent, "avg_word_len": word_len, "avg_sentence_len": per_sent,
        "lexical_diversity": F.when(n_words > 0, F.size(F.array_distinct(words)) / n_words).otherwise(F.lit(0.0)),
        "upper_ratio": share(r"[^\p{Lu}]+"), "digit_ratio": share(r"[^\p{Nd}]+"),
        "punct": F.length(F.regexp_replace(c, r"[^.,!?;:]+", "")),
        "readability": F.greatest(F.lit(0.0), F.least(F.lit(100.0), reading)),
    }


def sentiment(c) -> dict[str, Column]:
    """Lexicon overlap of the set of lower-case words: positive and negative
    words (a repeated word counts once), score (p - n) / (p + n + 1), ratios to
    the number of distinct words, intensity and a ±0.2 label."""
    c = F.col(c) if isinstance(c, str) else c
    toks = F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    pos = F.size(F.filter(toks, lambda w: w.isin(POSITIVE_WORDS)))
    neg = F.size(F.filter(toks, lambda w: w.isin(NEGATIVE_WORDS)))
    n = F.greatest(F.size(toks), F.lit(1))
    score = (pos - neg) / (pos + neg + 1)
    return {"positive": pos, "negative": neg, "sentiment": score, "positive_ratio": pos / n, "negative_ratio": neg / n,
            "intensity": (pos + neg) / n,
            "label": F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")}


def review_rollup(df: DataFrame, text: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sentiment distribution and mean, and the ``top`` most frequent
    non-trivial words (length > 3)."""
    s = df.select(*[v.alias(k) for k, v in sentiment(text).items()])
    dist = s.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.avg("sentiment").alias("mean_sentiment"))
    words = df.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 3)
    kw = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(top)
    return dist, kw


ENTITY_PATTERNS = {
    "money": r"[$€£₹]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|m|b|million|billion|thousand))?",
    "percent": r"\d+(?:\.\d+)?\s?%",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}",
    "quantity": r"\d+(?:\.\d+)?\s?(?:units|items|pieces|kg|lbs|tons|orders)",
}


def pattern_entities(df: DataFrame, text: str, key: str) -> DataFrame:
    """Money, percent, date and quantity mentions (match index per type)."""
    parts = [df.select(key, F.lit(kind).alias("entity"),
                       F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({pat})"), 1)).alias("match_index", "value"))
             for kind, pat in ENTITY_PATTERNS.items()]
    return reduce(DataFrame.unionByName, parts)


# fixed values: patterns of the mentions to find, matched without regard to case
SPAN_PATTERNS = {
    "money": [r"\$[\d,]+\.?\d*", r"₹[\d,]+\.?\d*", r"€[\d,]+\.?\d*", r"£[\d,]+\.?\d*",
              r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:dollars?|USD|rupees?|INR|euros?|EUR)\b"],
    "percentage": [r"\b\d+(?:\.\d+)?%", r"\b\d+(?:\.\d+)?\s*percent\b"],
    "date": [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b",
             r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{4}\b", r"\bQ[1-4]\s*\d{4}\b",
             r"\b(?:last|next|this)\s+(?:week|month|year|quarter)\b"],
    "quantity": [r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:units?|items?|pieces?|orders?)\b"],
}


def entity_spans(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, entity, start, end, value) of every money, percentage, date and quantity
    mention, in code points, end exclusive; the matches of one pattern do not overlap, those of
    different ones may.  One scan, texts pass Python in Arrow batches, no shuffle.  A null or
    empty text has none; a long text is read whole."""
    schema = T.StructType([T.StructField("_k", df.schema[key].dataType), T.StructField("entity", T.StringType()),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    forms = [(kind, p) for kind, patterns in SPAN_PATTERNS.items() for p in patterns]

    def spans(batches):
        compiled = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in forms]
        for pdf in batches:
            rows = [(k, kind, m.start(), m.end(), m.group()) for k, t in zip(pdf["_k"], pdf["_t"]) if isinstance(t, str)
                    for kind, p in compiled for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(spans, schema).withColumnRenamed("_k", key)


def column_mentions(df: DataFrame, text: str, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per row and column the first of the name's forms (as is, with '_' as space, with
    '_' removed) that the lower-case text holds, with its 1-based offset and its end; rows
    are told apart by ``key``, for turns the conversation and the turn.  One projection, no
    shuffle; a null or empty text mentions nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    low = F.lower(F.col(text))
    hits = []
    for c in columns:
        forms = list(dict.fromkeys([c.lower(), c.lower().replace("_", " "), c.lower().replace("_", "")]))
        hits.append(F.coalesce(*[F.when(F.instr(low, F.lit(f)) > 0, F.struct(
            F.lit(c).alias("column"), F.lit(f).alias("form"), F.instr(low, F.lit(f)).alias("offset"),
            (F.instr(low, F.lit(f)) + len(f) - 1).alias("end"))) for f in forms]))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")


def extract_numbers(c) -> Column:
    """Numbers in text with k/m/b suffixes normalised (array<double>)."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"(\d[\d,]*(?:\.\d+)?\s?[kmb]?)\b"), 1)

    def norm(s):
        num = F.regexp_replace(F.regexp_replace(s, r"[kmb]$", ""), r"[,\s]", "").try_cast("double")
        mult = F.when(s.endswith("k"), 1e3).when(s.endswith("m"), 1e6).when(s.endswith("b"), 1e9).otherwise(1.0)
        return num * mult
    return F.transform(raw, norm)


def proper_nouns(c) -> Column:
    """Capitalised words not at a sentence start."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]{2,})\b"), 1)


def grounding(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each assistant turn, the share of its numbers and capitalised
    names that occur in the preceding user turn (the context); verdict bands
    >= 0.8 grounded, >= 0.5 partial, else ungrounded (no claims -> grounded)."""
    a = conv.where(F.col(role) == "assistant").select(key, turn, F.col(text).alias("answer"))
    u = conv.where(F.col(role) == "user").select(key, (F.col(turn) + 1).alias(turn), F.col(text).alias("context"))
    j = a.join(u, [key, turn], "left")
    claims = F.array_distinct(F.concat(F.transform(extract_numbers("answer"), lambda x: x.cast("string")), proper_nouns("answer")))
    ctx = F.array_distinct(F.concat(F.transform(extract_numbers(F.coalesce("context", F.lit(""))), lambda x: x.cast("string")),
                                    proper_nouns(F.coalesce("context", F.lit("")))))
    n = F.size(claims)
    hit = F.size(F.array_intersect(claims, ctx))
    score = F.when(n == 0, F.lit(1.0)).otherwise(hit / n)
    return j.select(key, turn, n.alias("claims"), hit.alias("supported"), score.alias("score"),
                    F.when(score >= 0.8, "grounded").when(score >= 0.5, "partial").otherwise("ungrounded").alias("verdict"))


def grounding_in_context(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each assistant turn the numbers and names it claims that an earlier turn of the
    conversation, whoever spoke, holds.

    A claim is a distinct number (``k``, ``m``, ``b`` read as factors, equal to the cent) or a
    capitalised word of over three letters after a lower-case letter or a comma.  The context is
    never put together: each (conversation, claim) is looked up in one table of the turn that
    first held it, an equi-join of counts' size, so a long conversation spreads over tasks.
    ``confidence`` is the whole percentage supported, 70 without a claim, 0 for a null or empty
    answer or without an earlier text; from 50 it is ``grounded``, below 60 there is a
    ``warning`` (``low`` under 30) if a claim lacks support.  Turns are unique in a conversation.
    """
    t = conv.select(key, turn, role, F.coalesce(text, F.lit("")).alias("_t"))
    nums = F.transform(F.filter(extract_numbers("_t"), lambda x: x.isNotNull()), lambda x: F.format_string("%.2f", x))
    words = F.transform(F.regexp_extract_all("_t", F.lit(r"[a-z,]\s([A-Z][a-z]{3,})"), 1), F.lower)
    any_word = F.regexp_extract_all(F.lower("_t"), F.lit(r"([a-z]{4,})"), 1)
    claims = t.where(F.col(role) == "assistant").select(key, turn, F.explode(F.array_distinct(F.concat(nums, words))).alias("claim"))
    first = t.select(key, turn, F.explode(F.array_distinct(F.concat(nums, any_word))).alias("claim")).groupBy(key, "claim").agg(
        F.min(turn).alias("_first"))
    begun = t.where(F.col("_t") != "").groupBy(key).agg(F.min(turn).alias("_begun"))
    per = claims.join(first, [key, "claim"], "left").groupBy(key, turn).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("_first") < F.col(turn)).alias("supported"))
    a = t.where(F.col(role) == "assistant").join(per, [key, turn], "left").join(begun, key, "left")
    n, ok = (F.coalesce(c, F.lit(0).cast("long")) for c in ("claims", "supported"))
    asked = (F.col("_t") != "") & F.coalesce(F.col("_begun") < F.col(turn), F.lit(False))
    conf = F.when(~asked, 0).when(n == 0, 70).otherwise(F.floor(F.try_divide(ok * 100, n))).cast("int")
    out = a.select(key, turn, n.alias("claims"), ok.alias("supported"), conf.alias("confidence"))
    lacking = F.col("supported") < F.col("claims")
    return out.withColumns({"grounded": F.col("confidence") >= 50, "warning": F.when(
        lacking & (F.col("confidence") < 30), "low").when(lacking & (F.col("confidence") < 60), "some")})


def injection_flag(c) -> dict[str, Column]:
    """Flag when any pattern matches (case-insensitive) and the first
    matching pattern in list order."""
    c = F.col(c) if isinstance(c, str) else c
    hits = [F.when(c.rlike("(?i)" + p), F.lit(p)) for p in INJECTION_PATTERNS]
    first = F.coalesce(*hits)
    return {"unsafe": first.isNotNull(), "matched_pattern": first}


def tag_text(df: DataFrame, text: str, key: Sequence[str], rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Rules (tag, regex, weight) scored over a text column; the tag with
    the highest total weight wins (ties: tag name), else 'general'."""
    scores = {tag: reduce(lambda a, b: a + b, [F.when(F.col(text).rlike("(?i)" + r), F.lit(float(w))).otherwise(F.lit(0.0))
                                               for t, r, w in rules if t == tag]) for tag in sorted({t for t, _, _ in rules})}
    scored = df.select(*key, F.array(*[F.struct((-s).alias("minus"), F.lit(t).alias("tag")) for t, s in scores.items()]).alias("_s"))
    best = F.array_min("_s")  # the highest score, then the first name
    return scored.select(*key, F.when(best["minus"] < 0, best["tag"]).otherwise("general").alias("tag"),
                         F.coalesce(-best["minus"], F.lit(0.0)).alias("score"))


def user_facts(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               last_n: int = 5) -> DataFrame:
    """Name ("my name is X", "I'm X"), company ("I work at/for X") from
    user turns (latest mention wins) and the last ``last_n`` user turns."""
    u = conv.where(F.col(role) == "user")
    name = F.regexp_extract(F.col(text), r"(?i)\b(?:my name is|i am|i'm)\s+([A-Z][\w-]+)", 1)
    comp = F.regexp_extract(F.col(text), r"(?i)\bi work (?:at|for)\s+([A-Z][\w&-]+)", 1)
    x = u.select(key, turn, F.when(name != "", name).alias("name"), F.when(comp != "", comp).alias("company"), text)
    g = x.groupBy(key).agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col(turn))).alias("name"),
                           F.max_by("company", F.when(F.col("company").isNotNull(), F.col(turn))).alias("company"),
                           F.count(F.lit(1)).alias("user_turns"),
                           F.slice(F.array_sort(F.collect_list(F.struct(F.lit(0) - F.col(turn), F.col(turn).alias("t")))),
                                   1, last_n).alias("_last"))
    return g.select(key, "name", "company", "user_turns",
                    F.array_sort(F.transform("_last", lambda s: s["t"])).alias("last_user_turns"))


# fixed values: what a user turn speaks of, by words its text holds
TOPIC_WORDS = {
    "revenue": ["revenue", "sales", "income"],
    "customers": ["customer", "client", "buyer"],
    "products": ["product", "item", "sku"],
    "trends": ["trend", "growth", "forecast", "predict"],
    "comparison": ["compare", "versus", "vs", "difference"],
    "metrics": ["kpi", "margin", "profit", "roi", "cost"],
    "segments": ["region", "country", "state", "market", "segment"],
}


def user_topics(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, topic, first_turn, last_turn, turns) of the topics its user turns speak
    of.  At most seven rows a conversation, partially aggregated; a null text speaks of nothing."""
    low = F.lower(F.col(text))
    hits = F.array(*[F.when(any_of([low.contains(w) for w in words]), F.lit(topic)) for topic, words in TOPIC_WORDS.items()])
    u = conv.where(F.col(role) == "user").select(key, turn, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("topic"))
    return u.groupBy(key, "topic").agg(F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count(F.lit(1)).alias("turns"))


def _word_runs(words: str, ngram: int) -> Column:
    """Runs of 1 to ``ngram`` words of an array column, joined by spaces."""
    runs = [F.col(words)]
    for n in range(2, ngram + 1):  # a run of n is a run of n - 1 and the word after it
        left = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], 1, left), F.slice(words, n, left), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs)


def _counted(rows: DataFrame, terms: Column, many: DataFrame | None = None) -> DataFrame:
    """(term, _total, df): occurrences and rows of each term; with ``many`` only of terms whose ends
    are among its words.  A row tells its terms once more without repeats, so counting is a partial
    aggregate by term alone and no (row, term) pair is shuffled."""
    both = rows.select(terms.alias("_t")).select(F.explode(F.array(
        F.struct(F.col("_t").alias("t"), F.lit(1).alias("n")), F.struct(F.array_distinct("_t").alias("t"), F.lit(0).alias("n")))).alias("e"))
    long = _among(both.select(F.explode("e.t").alias("term"), F.col("e.n").alias("n")), many)
    return long.groupBy("term").agg(F.sum("n").alias("_total"), F.sum(1 - F.col("n")).alias("df"))


def _among(long: DataFrame, many: DataFrame | None) -> DataFrame:
    for place in (1, -1) if many is not None else ():
        end = many.select(F.col("term").alias("_end"))
        long = long.join(end, F.substring_index("term", " ", place) == F.col("_end"), "left_semi")
    return long


def frequent_terms(rows: DataFrame, words: str, vocab: int, min_df: float, max_df: float, ngram: int,
                   key: str | None = None) -> DataFrame:
    """(term, df, _total) of the ``vocab`` most frequent runs of up to ``ngram`` words (ties by term)
    in at least ``min_df`` and at most ``max_df`` rows; rows of the same ``key`` count as one.

    Words are counted first.  A run occurs no oftener than any of its words, so once ``vocab`` words
    are known to count, a run with a rarer word than the last of them cannot be among the most frequent,
    and only runs between the other words are counted: exactly, and without a shuffle of all runs."""
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), (F.count_distinct(key) if key else F.count(F.lit(1))).alias("n")).first()
    n, extra = sizes["n"], sizes["all"] - sizes["n"]  # rows that share their key with another
    one = written(_counted(rows, _word_runs(words, 1)), "words")
    sure = one.where((F.col("df") - extra >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("_total")).limit(vocab)
    least = sure.agg(F.when(F.count(F.lit(1)) >= vocab, F.min("_total"))).first()[0] or 0
    many = written(one.where(F.col("_total") >= least).select("term"), "frequent-words")
    runs = _word_runs(words, ngram)
    if extra:
        again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
        shared = _among(rows.join(again, key, "left_semi").select(key, F.explode(runs).alias("term")), many)
        shared = shared.groupBy(key, "term").agg(F.count(F.lit(1)).alias("_total")).groupBy("term").agg(
            F.sum("_total").alias("_total"), F.count(F.lit(1)).alias("df"))
        freq = _counted(rows.join(again, key, "left_anti"), runs, many).unionByName(shared).groupBy("term").agg(
            F.sum("_total").alias("_total"), F.sum("df").alias("df"))
    else:
        freq = _counted(rows, runs, many)
    top = freq.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return top.orderBy(F.desc("_total"), F.asc("term")).limit(vocab).select("term", "df", "_total")


def tfidf_terms(df: DataFrame, text: str, key: str, vocab: int = 300, min_df: int = 2, max_df: float = 0.9, ngram: int = 2) -> DataFrame:
    """(key, term, tf, weight): TF-IDF over words of two characters and more, lower-case,
    and runs of up to ``ngram`` of them.

    Terms in at least ``min_df`` and at most ``max_df`` of all rows count; the ``vocab`` most
    frequent of them (ties by term) are the vocabulary.  Weight: (1 + ln tf) x (1 + ln((1 + n) /
    (1 + df))), scaled to length 1 a row.  Only the pairs of a row and a term of the vocabulary are
    shuffled, only the vocabulary, of a fixed size, is broadcast.  Rows without a term of the vocabulary,
    null and empty texts among them, have none; rows with the same key count as one, rows without a key
    are left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    base = df.where(F.col(key).isNotNull()).select(key, words.alias("_w"))
    top = written(frequent_terms(base, "_w", vocab, min_df, max_df, ngram, key), "vocabulary")
    rows = df.agg(F.count_distinct(key)).scalar()
    idf = 1 + F.log((1 + rows) / (1 + F.col("df")))
    long = base.select(key, F.explode(_word_runs("_w", ngram)).alias("term"))
    tf = long.join(F.broadcast(top.select("term", "df")), "term").groupBy(key, "term", "df").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.withColumn("_raw", (1 + F.log("tf")) * idf)
    found = raw.groupBy(key).agg(F.collect_list(F.struct("term", "tf", "_raw")).alias("_f"),  # at most ``vocab`` a row
                                 F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"))
    return found.select(key, "_norm", F.explode("_f").alias("f")).select(
        key, "f.term", "f.tf", (F.col("f._raw") / F.col("_norm")).alias("weight"))


def term_relevance(df: DataFrame, text: str, query: str) -> Column:
    """Share of distinct query terms present in the text."""
    q = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    toks = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"))
    return F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in q]))) / F.lit(max(len(q), 1))


def tfidf(df: DataFrame, text: str, vocab: int = 500, min_df: float = 2.0, max_df: float = 0.9, ngram: int = 2,
          k: int | None = None):
    """RegexTokenizer -> StopWordsRemover -> NGram (1..n merged) ->
    CountVectorizer(minDF, maxDF) -> IDF, optional PCA(k) (for SVD).  Returns
    the fitted PipelineModel; ``transform`` adds ``features``.  The vocabulary, which
    CountVectorizer would count as all terms of all rows, is that of ``frequent_terms``: equally frequent terms in order,
    not as they happen to arrive."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
              StopWordsRemover(inputCol="_tok", outputCol="_t1")]
    cols = ["_t1"]
    for n in range(2, ngram + 1):
        stages.append(NGram(n=n, inputCol="_t1", outputCol=f"_t{n}"))
        cols.append(f"_t{n}")
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(cols)}) AS _terms FROM __THIS__"))
    prep = Pipeline(stages=stages).fit(df)
    terms = prep.transform(df)
    n = df.count()
    least, most = min_df if min_df >= 1 else min_df * n, max_df if max_df < 1 else max_df / n
    top = frequent_terms(terms.select("_t1"), "_t1", vocab, least, most, ngram).collect()  # of a fixed size
    if not top:
        raise ValueError("no term is in enough rows: lower min_df")
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in sorted(top, key=lambda r: (-r["_total"], r["term"]))],
                                                  inputCol="_terms", outputCol="_tf")
    last = [IDF(inputCol="_tf", outputCol="features" if not k else "_tfidf")]
    if k:
        last.append(PCA(k=k, inputCol="_tfidf", outputCol="features"))
    return PipelineModel([*prep.stages, *[counts], *Pipeline(stages=last).fit(counts.transform(terms)).stages])


# ------------------------------------------------------------- HTML pages

class _PageParser(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "header", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.desc, self.text, self.links, self.tables = "", "", [], [], []
        self._skip, self._in_title, self._table, self._row, self._cell = 0, False, None, None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self._skip += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "meta" and (a.get("name") or "").lower() == "description":
            self.desc = a.get("content") or ""
        elif tag == "a" and a.get("href") and not self._skip:
            self.links.append(a["href"])
        elif tag == "table":
            self._table = []
        elif tag == "tr" and self._table is not None:
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []

    def handle_endtag(self, tag):
        if tag in self.SKIP and self._skip:
            self._skip -= 1
        elif tag == "title":
            self._in_title = False
        elif tag in ("td", "th") and self._cell is not None and self._row is not None:
            self._row.append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None and self._table is not None:
            self._table.append(self._row)
            self._row = None
        elif tag == "table" and self._table is not None:
            self.tables.append(self._table)
            self._table = None

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self.text.append(data)
            if self._cell is not None:
                self._cell.append(data)


PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))])


_PLAIN_LINK = re.compile(r"https?://[a-z0-9.-]+/[A-Za-z0-9/_-]+")  # joined to any address it stays as it is


def parse_page(html: str | None, url: str | None, max_text: int | None = None, max_tables: int | None = None,
               max_links: int | None = None) -> dict | None:
    """N9 for one page (stdlib parser): title, description, visible text
    (script/style/nav/footer/header dropped, whitespace collapsed), tables and
    absolute links.  All of them are returned unless a caller asks for fewer."""
    if html is None:
        return None
    p = _PageParser()
    try:
        p.feed(html)
        p.close()
    except Exception:  # noqa: BLE001 - malformed markup keeps what was parsed
        pass
    text = " ".join(" ".join(p.text).split())[:max_text]
    links: dict[str, None] = {}  # in order, each once
    for h in p.links:
        try:
            u = h if _PLAIN_LINK.fullmatch(h) else urljoin(url or "", h)
        except ValueError:  # no address: such as an unclosed bracket
            continue
        if u.startswith(("http://", "https://")):
            links.setdefault(u)
    return {"title": " ".join(_html.unescape(p.title).split()), "description": p.desc, "text": text,
            "links": list(links)[:max_links], "tables": p.tables[:max_tables]}


@F.pandas_udf(PAGE_SCHEMA)
def _parse_pages(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [parse_page(h, u) or {"title": None, "description": None, "text": None, "links": [], "tables": []}
            for h, u in zip(html, url)]
    return pd.DataFrame(rows, columns=["title", "description", "text", "links", "tables"])


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per page with the parsed struct's fields."""
    return pages.select(key, url, _parse_pages(F.col(html), F.col(url)).alias("p")).select(key, url, "p.*")


def page_links(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Link edge list (page, link, domain)."""
    e = parsed.select(key, F.posexplode("links").alias("link_index", "link"))
    return e.withColumn("domain", F.try_parse_url("link", F.lit("HOST")))


def domain_link_counts(links: DataFrame) -> DataFrame:
    """Links per target domain."""
    return links.groupBy("domain").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


def page_table_cells(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Table cells as (page, table, row, column, value)."""
    t = parsed.select(key, F.posexplode("tables").alias("table_index", "rows"))
    r = t.select(key, "table_index", F.posexplode("rows").alias("row_index", "cells"))
    return r.select(key, "table_index", "row_index", F.posexplode("cells").alias("column_index", "value"))


_PIPE_ROW = re.compile(r"^\s*\|(.+)\|\s*$")
_SEP_ROW = re.compile(r"^\s*\|?\s*:?-{3,}")

MD_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("table_index", T.IntegerType()), T.StructField("row_index", T.IntegerType()),
    T.StructField("column", T.StringType()), T.StructField("value", T.StringType())]))


def markdown_tables_doc(text: str | None) -> list[dict]:
    """N10 for one text: pipe tables (header row, separator, body rows) to
    long (table, row, column, value) cells."""
    if not text:
        return []
    out, tbl, header, row = [], -1, None, 0
    lines = text.split("\n")
    for i, ln in enumerate(lines):
        m = _PIPE_ROW.match(ln)
        if not m:
            header = None
            continue
        cells = [c.strip() for c in m.group(1).split("|")]
        if header is None:
            if i + 1 < len(lines) and _SEP_ROW.match(lines[i + 1]):
                header, tbl, row = cells, tbl + 1, 0
            continue
        if _SEP_ROW.match(ln):
            continue
        for h, v in zip(header, cells):
            out.append({"table_index": tbl, "row_index": row, "column": h, "value": v})
        row += 1
    return out


def markdown_tables(df: DataFrame, text: str, key: str) -> DataFrame:
    """Long table of pipe-table cells per document."""
    return _flat(df, text, key, MD_SCHEMA, markdown_tables_doc)


"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of a path is content-addressed by the SHA-256 of its text.  The
ledger has, per blob, the (rule, version) pairs that were run on it and the
spans they found.  A scan takes each blob once, however many paths hold it,
runs only the pairs that the ledger has not seen, and findings are joined back
to all paths.

Defined cases: a null text is the empty text; an empty text has no spans; a
repeated row is another path of the same blob and gets its own result row; an
empty table gives an empty result; other columns are never read, so extra or
clashing names do not matter.  Texts of any length are read whole; no pattern
repeats a group.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import boxed, cut, unboxed


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match whose
    ``group`` is shorter than ``least`` characters is dropped afterwards.
    ``tail`` is matched once, at the start of the stretch between a match and the
    next; what it takes belongs to the match."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1
    tail: str | None = None


# A private key whole: from its header to its END line if that comes before another header; else the lines
# of name and value after the header up to a blank line, if any, and the base64 that follows (whatever quotes,
# comment or diff marks stand between) up to its last run of 16 characters, and a shorter last line.  A header
# that no key follows is taken alone.  Only single characters are repeated, never groups: Java's engine walks
# such a repetition in a loop, however long the text, and takes one for a group on its stack.
PEM_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
PEM_TAIL = (r"^(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
            r"|(?:[ \t\r\n]+[A-Z][A-Za-z-]*: [\s\S]*?\n[ \t\r]*\n)?[ \t\r\n\\\"']?[A-Za-z0-9+/= \t\r\n\\\"'#>*|,-]*[A-Za-z0-9+/=]{16}"
            r"(?:[ \t\r\n\\][ \t\r\n\\nr]*[A-Za-z0-9+/=]{1,15}(?:[ \t]*[\r\n\\\"']|[ \t]*\z)|[\r\n]+-[A-Za-z0-9+/=]{1,15})?)")

# fixed values: the kinds and patterns of the contract, in its order, then added ones
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 or more is what [0-9a-f]+ takes whole
    Rule("pem", PEM_HEAD, 0, 1, version=3, tail=PEM_TAIL),
)
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:bigint,kind_no:int,stop:bigint,rule:string>>"
LEDGER_SCHEMA = f"blob string, scanned array<struct<rule:string,version:int>>, found {SPAN}"


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, rule: Rule, kind_no: int) -> Column:
    """Spans of one rule: the pieces between the matches and the matches
    themselves give every start and end by adding up their lengths."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        stop = end + F.length(F.regexp_extract(x["next"], rule.tail, 0)) if rule.tail else end
        size = F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) if rule.group else F.length(x["hit"])
        span = F.struct(start.cast("long").alias("start"), F.lit(kind_no).alias("kind_no"),
                        stop.cast("long").alias("stop"), F.lit(rule.name).alias("rule"))
        more = F.when(F.coalesce(size >= rule.least, F.lit(False)), F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], more).alias("out"))

    parts = [gaps.alias("gap"), hits.alias("hit")] + ([F.slice(gaps, 2, F.size(gaps)).alias("next")] if rule.tail else [])
    pairs = F.filter(F.arrays_zip(*parts), lambda x: x["hit"].isNotNull())
    walked = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")),
                         step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules=RULES, wanted=None) -> Column:
    """Spans of all rules by start, then rule order; ``wanted`` maps a rule to
    a condition under which it is run."""
    each = []
    for i, rule in enumerate(rules):
        spans = rule_spans(text, rule, i)
        if wanted is not None:
            spans = F.when(wanted(rule), spans).otherwise(F.array().cast(SPAN))
        each.append(spans)
    return F.array_sort(F.concat(*each))


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``paths`` that
    ``ledger`` has not seen.  Equal blobs meet by a partial aggregate, so a blob
    with millions of paths moves once per task."""
    versions = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = (paths.select(body.alias("body")).withColumn("blob", content_address(F.col("body")))
             .groupBy("blob").agg(F.first("body").alias("body")))
    if ledger is None:
        todo = blobs.withColumn("todo", versions)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn(
            "todo", F.when(F.col("seen").isNull(), versions).otherwise(F.array_except(versions, F.col("seen"))))
        todo = todo.where(F.size("todo") > 0)

    def wanted(rule: Rule) -> Column:
        return F.exists(F.col("todo"), lambda x: x["rule"] == rule.name)

    found = all_spans(F.col("body"), rules, None if ledger is None else wanted)
    return todo.select("blob", F.col("todo").alias("scanned"), found.alias("found"))


def merged(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row per blob with the findings of the rules' present versions.  A
    blob has a bounded number of ledger rows: one per rule version at most."""
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    row = ledger.select("blob", F.filter("scanned", lambda x: F.array_contains(current, x)).alias("scanned"), "found")
    names = F.transform(F.col("scanned"), lambda x: x["rule"])
    row = row.select("blob", F.filter("found", lambda s: F.array_contains(names, s["rule"])).alias("found"))
    return row.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def join_back(paths: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """All paths with the ``found`` spans of their blob."""
    return paths.withColumn("blob", content_address(F.col(text))).join(findings, "blob")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["rule"] == kind)).cast("long")


def digest(paths: DataFrame) -> DataFrame:
    """The contract's columns: all paths of ``documents`` from a fresh ledger."""
    docs = paths.select("doc_id", "text")
    ledger = cut(scan_unseen(docs), "ledger")  # one row per blob: joins below are split where a blob is hot
    named = docs.select("doc_id", content_address(F.col("text")).alias("blob"))
    out = named.join(ledger.select("blob", "found"), "blob")
    base = F.filter("found", lambda s: s["rule"].isin(*BASE_KINDS))
    return out.select("doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE_KINDS],
                      F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
                      span_text(F.col("found")).alias("spans"), "blob")


def redact(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``[rule]``; other rows and
    columns stay.  Overlapping spans are replaced as one, named by the first."""
    ledger = cut(scan_unseen(docs, rules=rules, text=text), "ledger").where(F.size("found") > 0)
    body = F.col(f"_row.`{text}`")
    hit = boxed(docs).withColumn("_blob", content_address(body)).join(
        ledger.select(F.col("blob").alias("_blob"), F.col("found").alias("_found")), "_blob", "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], body.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                         F.concat(F.lit("["), s["rule"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("_found", zero, step, lambda a: F.concat(a["out"], body.substr((a["at"] + 1).cast("int"), F.length(body))))
    changed = F.when(F.col("_found").isNotNull(), F.col("_row").withField(f"`{text}`", rest)).otherwise(F.col("_row"))
    return unboxed(hit.select(changed.alias("_row")))

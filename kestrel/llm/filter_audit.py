"""Filter interaction audit by the Hart-Mas-Colell potential (DataFrame functions only).

Every document gets one bit per filter that it fails.  The removal game of a part
of the corpus values a coalition S of filters with v(S), the number of documents
that fail some filter of S.  Its potential is P(empty) = 0 and

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,

computed over the coalitions in the order of their bit masks, in which subsets come
first.  The Shapley value of a filter is P(all) - P(all without it); k! P(S) is a
whole number for k filters, so all of it is exact in 64-bit integers.  What a filter
removes at a step of an order is the difference v(S with it) - v(S), S being the
filters before it.

Documents are reduced to counts per (part, set of failed filters) by a partial
aggregate; beyond that no step depends on the number of documents.  Copies are
found by the SHA-256 of the text: its least doc_id, from a partial aggregate, meets
the documents by (text, doc_id); what finds no partner is a copy.  So no task gets
all copies of a text that a third of the rows share.

Defined cases: a null text is the empty text, a null part the empty string; an empty
text has no words and fails A only.  A null doc_id counts as larger than all others
and two null ids as equal; a repeated row has equal ids, so neither is the copy of
the other.  A label counts when any label row of the id says 1; null ids have no
label.  Texts of any length are read whole.  An empty table gives an empty result.
Columns but doc_id, text and the part are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut

LETTERS = "ABCDE"
GAIN = ("n", "good", "toxic")  # what is counted of each part and set of failed filters


def failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails the filters A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return [F.size(words) < 200,
            F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(50),
            F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100) > F.length(text) * F.lit(3),
            text.rlike(r"[#$%&*|]")]


def as_mask(bits: list[Column]) -> Column:
    out = F.lit(0)
    for i, bit in enumerate(bits):
        out = out + F.when(bit, 1 << i).otherwise(0)
    return out


def measured(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask of A to E), one row per document."""
    body = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("body"))
    rows = cut(body.select("doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("same"),
                           as_mask(failures(F.col("body"))).alias("mask")), "failures")
    # one row per text; a row meets it by text and id, so that many copies of a text meet nowhere
    firsts = rows.groupBy("same").agg(F.min("doc_id").alias("first")).withColumnRenamed("same", "first_same")
    own = (F.col("same") == F.col("first_same")) & F.col("doc_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, own, "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("first_same").isNull(), 16).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per (part, mask)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(c) for c in GAIN[1:]])


def games(counts: DataFrame, filters: int) -> DataFrame:
    """One row per part: ``v_<count>``, the value of every coalition by its mask,
    and ``potential``, filters! times P."""
    whole = 1 << filters
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *GAIN)).alias("cells"))  # 2^filters cells at most

    def value(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(whole - 1)), lambda s: F.aggregate(
            "cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[name]).otherwise(0)))

    parts = parts.select("part", F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("docs"),
                         *[value(c).alias(f"v_{c}") for c in GAIN])

    def potential(known: Column, s: Column) -> Column:
        below = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(filters)]
        top = F.get("v_n", s) * factorial(filters) + sum(below[1:], below[0])
        return F.array_append(known, F.call_function("div", top, F.bit_count(s).cast("long")))

    return parts.withColumn("potential", F.aggregate(
        F.sequence(F.lit(1), F.lit(whole - 1)), F.array(F.lit(0).cast("long")), potential))


def steps(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """All orders of the filters and their steps, per part."""
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    rows = parts.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def bit(letter: Column) -> Column:
        out = F.lit(0)
        for i, x in enumerate(letters):
            out = F.when(letter == x, 1 << i).otherwise(out)
        return out

    places = F.sequence(F.lit(1), F.lit(len(letters)))
    before = F.aggregate(F.filter(places, lambda p: p < F.col("step")), F.lit(0),
                         lambda acc, p: acc + bit(F.substr("filter_order", p, F.lit(1))))
    rows = rows.withColumn("own", bit(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    whole = (1 << len(letters)) - 1

    def gained(name: str) -> Column:
        return F.get(f"v_{name}", F.col("before") + F.col("own")) - F.get(f"v_{name}", F.col("before"))

    removed, all_docs = gained("n"), F.get("v_n", F.lit(whole))
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - F.get("v_n", F.col("before") + F.col("own"))).alias("kept"),
        removed.alias("removed"), (F.get("v_n", F.col("own")) - removed).alias("redundant"),
        (all_docs - F.get("v_n", F.lit(whole) - F.col("own"))).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(whole)) - F.get("potential", F.lit(whole) - F.col("own"))).alias("shapley"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return steps(games(cells(measured(docs), labels), len(LETTERS)))

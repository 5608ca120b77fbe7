"""op11 against a brute-force run of all 120 orders, and on odd tables."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kestrel.llm import filter_audit
from kestrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows):
    """Per row of (doc_id, text, lang): (id, part, set of failed letters)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
               "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
               "E": t in least and (i is None or i > least[t])}
        yield i, lang or "", {k for k, v in bad.items() if v}


def brute(rows, good=(), toxic=()):
    docs = list(fails(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(letter in f for _, f in mine) - len(gone),
                                          sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone),
                                          sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_equals_brute_force_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = labels.collect()
    want = brute(rows, {r.doc_id for r in marks if r.quality == 1}, {r.doc_id for r in marks if r.toxic == 1})
    assert collected(QUERIES["op11_filter_audit"](spark, SF)) == want


@pytest.mark.parametrize("many", [0, 1, 9])
def test_odd_rows(spark, many):
    rows = [(1, "A B c", "en"), (2, None, None), (3, "", "en"), (2, None, None), (5, "w " * 40_000 + "#", "la"), (4, "A B c", "la"),
            (None, "A B c", None), (None, "alone", "en"), (None, "alone", "en")][:many]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("mine") for c in ("part", "mask", "same", "body", "first", "n", "quality", "good")})
    labels = spark.createDataFrame([(4, 1, None), (4, 1, 1), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = collected(filter_audit.digest(docs, labels))
    assert got == brute(rows, {4}, {4, 5})
    assert len(got) == 600 * len({r[2] or "" for r in rows})

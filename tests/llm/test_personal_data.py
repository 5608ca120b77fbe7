"""op12: base spans against the plain patterns, the trees against Spark ML, added
spans on marked texts, and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kestrel.llm import personal_data as P
from kestrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {  # the contract's patterns, as they stand
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and doubled % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def card(rng, n=16, sep="", good=True):
    d = [rng.randrange(10) for _ in range(n - 1)]
    last = next(x for x in range(10) if P.luhn("".join(map(str, d)) + str(x)) == good)
    d = "".join(map(str, [*d, last]))
    return sep.join(d[i:i + 4] for i in range(0, n, 4))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        alphabet = rng.choice(["a1.@", "12.", "1 -", "+1 ()-.", "aZ09._%+-@ .", "0123456789 -.+@a"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 70)))
        if rng.random() < 0.5:
            t += rng.choice(["", " "]) + card(rng, rng.randrange(13, 21), rng.choice(["", " ", "-"]), rng.random() < 0.8) + rng.choice(["", ".1", "\n"])
        assert P.base_spans(t) == plain(t), t


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "1 " * 200_000, "+1" + " " * 400_000,
                                  "x" * 400_000 + "@b.c", "1:2" * 100_000, " at " * 100_000, "12-345 " * 60_000, "a@b.c " * 20_000])
def test_long_texts_end(text):
    base = P.base_spans(text)
    P.candidates(text, base)
    if len(base) < 2:
        assert sum(k == P.EMAIL for _, k, _ in base) == text.endswith("@b.c")


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        base = plain(text or "")
        assert tuple(r[f"n_{k}"] for k in P.KINDS) == tuple(sum(x == k for _, x, _ in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(P.shown(base).encode()).hexdigest()
        assert set(P.shown(base).split(",")) - {""} <= set(r.spans.split(","))


def test_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sorted(QUERIES["op12_personal_data"](spark, SF).collect(), key=lambda r: r.doc_id)
    check(rows, [texts[r.doc_id] for r in rows])


def corpus():
    """Texts with base forms, looser forms after a cue, and numbers that are neither."""
    rng, out = random.Random(9), []
    word = lambda: rng.choice("alder birch cedar doing eager fable grain house".split())
    for i in range(600):
        number = "".join(str(rng.randrange(10)) for _ in range(10))
        kind = i % 8
        body = [f"mail7.{word()}@host{i}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.3.{i % 256}", card(rng),
                f"+1 ({number[:3]}) 555-{number[3:7]}", f"phone: 0{number[:3]} {number[3:6]} {number[6:]}",
                f"card number {card(rng, sep='.')}", f"version 2.{i}.300.7", f"order {card(rng, good=False)} of 20{i % 90:02d}-01-12"][kind]
        out.append((i, kind, " ".join([word() for _ in range(5)]) + " " + body + " " + " ".join(word() for _ in range(5))))
    return out


def test_looser_forms_are_added_and_clean_texts_left_alone(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, text string")
    rows = sorted(P.digest(docs).collect(), key=lambda r: r.doc_id)
    check(rows, [t for *_, t in texts])
    added = {k: [r for r, (_, kind, t) in zip(rows, texts) if kind == k and r.spans != P.shown(plain(t))] for k in range(8)}
    assert len(added[4]) >= 70 and len(added[5]) >= 70  # of 75 each
    assert not any(added[k] for k in (0, 1, 2, 3, 6, 7))
    assert all(r.spans.startswith("phone:") for r in added[4]) and all(r.spans.startswith("card:") for r in added[5])


def test_redact_leaves_no_span(spark):
    texts = [*[t for *_, t in corpus()], None, ""]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    got = {r.doc_id: r for r in P.redact(docs).collect()}
    assert len(got) == len(texts) and all(r._row == "mine" for r in got.values())
    assert got[600].text is None and got[601].text == ""
    assert not any(P.base_spans(r.text or "") for r in got.values())
    assert got[4].text.count("[phone]") == 1 and got[7].text == texts[7]


def test_forest_equals_spark_ml(spark):
    from pyspark.ml.classification import GBTClassifier
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (500, 4)).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5) ^ (rng.random(500) < 0.1)).astype(float)
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, x array<double>").select("y", "x", array_to_vector("x").alias("v"))
    model = GBTClassifier(labelCol="y", featuresCol="v", maxIter=5, maxDepth=4, seed=1).fit(rows)
    forest = P.Forest(tuple(P.parsed(t.toDebugString) for t in model.trees), tuple(model.treeWeights))
    got = model.transform(rows).collect()
    assert np.allclose([r.probability[1] for r in got], forest.scores(np.array([r.x for r in got])), atol=1e-9)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (4, "x " * 50_000 + "1.2.3.4"), (5, "é🙂 1.2.3.4 a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("mine") for c in ("base", "found", "c", "kind", "label", "x", "spans")})
    got = sorted(P.digest(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    check(got, [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))])
    assert got[-2].spans == "ip:3:10,email:11:16"
    assert P.digest(docs.limit(0)).collect() == []

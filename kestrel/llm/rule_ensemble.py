"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest of shallow trees is grown on the statistics of labelled texts.
Every path from a root is a conjunctive rule; a lasso logistic regression weighs
the rules, and the rules with a weight are compiled into one Spark column.

Defined cases: a null text is the empty text; every statistic of an empty text
is 0; labels that are null or of other documents are not used; with no labels
or one class only the score is the share of label 1, or 0.5; repeated rows get
equal scores; an empty table gives an empty result; texts of any length are read
whole, once.  Columns but doc_id and text
(doc_id and quality of the labels) are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut, fold, held_out

TREES, DEPTH, SEED = 16, 3, 7
LASSO = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Names and values of the statistics of a text that is not null."""
    n = F.length(text).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")

    def of(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def only(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("double")

    return {
        "chars": F.log1p(n),
        "word_length": of(n, n_words),
        "long_words": of(F.size(F.filter(words, lambda w: F.length(w) > 12)), n_words),
        "letters": of(only(r"\p{L}"), n),
        "upper": of(only(r"\p{Lu}"), n),
        "digits": of(only(r"0-9"), n),
        "symbols": of(only(r"#$%&*@^~|<>{}=_+\\\[\]"), n),
        "stops": of(only(r".!?"), n_words),
        "shouts": of(only("!"), n_words),
        "new_words": of(F.size(F.array_distinct(words)), n_words),
        "line_length": of(n, n_lines),
        "new_lines": of(F.size(F.array_distinct(lines)), n_lines),
        "ended_lines": of(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?]\s*$"))), n_lines),
        "markup": of(F.regexp_count(text, F.lit(r"</?[a-z]+|&[a-z]+;|https?://")).cast("double"), n_words),
    }


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus one column per statistic, prefixed with ``s_``."""
    body = rows.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    return body.select("*", *[v.cast("double").alias(f"s_{k}") for k, v in statistics(F.col("_body")).items()]).drop("_body")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, "<=" or ">", bound) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, bound in self.conditions:
            out = out & ((F.col(name) <= bound) if op == "<=" else (F.col(name) > bound))
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(described: str, names: list[str]) -> list[Rule]:
    """The paths of a tree (as Spark ML describes it) as rules, one per node."""
    out, path = [], []
    for line in described.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1]) - 2
            path = [*path[:depth], (names[int(m[2])], m[3], float(m[4]))]
            tight: dict[tuple[str, str], float] = {}
            for name, op, bound in path:
                seen = tight.get((name, op), bound)
                tight[name, op] = min(seen, bound) if op == "<=" else max(seen, bound)
            out.append(Rule(tuple(sorted((n, o, b) for (n, o), b in tight.items()))))
    return out


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """``labelled``: the ``s_`` columns and a 0/1 label; all of its rows are used,
    in Spark ML's distributed learners."""
    names = [c for c in labelled.columns if c.startswith("s_")]
    seen = {r["label"]: r["count"] for r in labelled.groupBy(F.col(label).cast("int").alias("label")).count().collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return Ensemble({0: -30.0, 1: 30.0}.get(share, 0.0), ())
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(labelled.withColumn("y", F.col(label).cast("double")))
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(rows.select("y", "features"))
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString, names)}, key=lambda r: (len(r.conditions), r.conditions))
    hits = cut(labelled.select(F.col(label).cast("double").alias("y"), F.array(*[r.column().cast("double") for r in rules]).alias("hits")), "hits")
    vectors = hits.select("y", array_to_vector("hits").alias("x"))
    fitted = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(vectors)
    weights = fitted.coefficients.toArray()
    return Ensemble(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every document, written once: the numbers of a row, not
    its text, are what training and scoring read and shuffle."""
    rows = measured(docs.select("doc_id", "text"))
    return cut(rows.select("doc_id", *[c for c in rows.columns if c.startswith("s_")]), "measured")


def train(numbers: DataFrame, labels: DataFrame) -> Ensemble:
    """From the labelled documents outside the held-out fold; ``numbers`` as ``measure`` gives them."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1)).select("doc_id", F.col("quality").alias("label"))
    return fit(cut(numbers.join(known, "doc_id"), "labelled"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    numbers = measure(docs)
    out = numbers.withColumn("score", train(numbers, labels).score())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

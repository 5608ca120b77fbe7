"""A training corpus from the raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

1. language ID: texts without a language (null, or no letters) go;
2. MinHash near-dedup: one document of each class of near copies stays;
3. secret scans: every secret found is replaced by the name of its rule;
4. mixing: documents are repeated or left out so that sources meet their targets;
5. best-fit packing: the pieces of all documents with their places in sequences.

ORACLE_SQL is None: stages 1, 2 and 5 are not SQL-expressible; the tests compare
the result with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bag_minhash, language_mixture, mixing, packing, secret_ledger
from kestrel.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` counted again where a text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("language", lambda spark, docs, sf_dir: language_mixture.keep_known(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: bag_minhash.keep_one(docs)),
    ("secrets", lambda spark, docs, sf_dir: with_length(secret_ledger.redact(docs))),
    ("mix", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("pack", lambda spark, docs, sf_dir: packing.digest(docs)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

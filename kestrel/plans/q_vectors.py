"""Registered vector / retrieval queries.  Queries are the
per-label centroids of ``embeddings`` (bounded by the label count)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import vectors as V
from kestrel.plans.registry import query
from kestrel.session import Tables

CENTROID_SQL = """c AS (SELECT label AS query_id, list(m ORDER BY i) AS centroid FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"""


def _emb(t: Tables):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _queries(t: Tables):
    return V.centroids(_emb(t), "embedding", ["label"]).select(F.col("label").alias("query_id"),
                                                              F.col("centroid").alias("embedding"))


@query("o01_similarity", f"""WITH {CENTROID_SQL}
SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS cosine,
  1 / (1 + list_distance(e.embedding::DOUBLE[], c.centroid)) AS l2_sim,
  list_inner_product(e.embedding::DOUBLE[], c.centroid) AS dot FROM embeddings e JOIN c ON e.label = c.query_id""")
def o01_similarity(spark, sf):
    t = Tables(spark, sf)
    j = _emb(t).join(_queries(t).withColumnRenamed("embedding", "centroid"), F.col("label") == F.col("query_id"))
    return j.select("vec_id", V.cosine("embedding", "centroid").alias("cosine"),
                    V.l2_similarity("embedding", "centroid").alias("l2_sim"), V.dot("embedding", "centroid").alias("dot"))


@query("o02_knn_cosine", f"""WITH {CENTROID_SQL},
s AS (SELECT c.query_id, e.vec_id AS doc_id, list_cosine_similarity(c.centroid, e.embedding::DOUBLE[]) AS score FROM c, embeddings e)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def o02_knn_cosine(spark, sf):
    t = Tables(spark, sf)
    return V.knn(_emb(t), _queries(t), k=5, metric="cosine")


@query("o03_knn_l2", f"""WITH {CENTROID_SQL},
s AS (SELECT c.query_id, e.vec_id AS doc_id, 1 / (1 + pow(list_distance(c.centroid, e.embedding::DOUBLE[]), 2)) AS score
  FROM c, embeddings e)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def o03_knn_l2(spark, sf):
    t = Tables(spark, sf)
    return V.knn(_emb(t), _queries(t), k=5, metric="l2")


@query("o04_source_balanced")
def o04_source_balanced(spark, sf):
    t = Tables(spark, sf)
    hits = V.knn(_emb(t), _queries(t), k=20).join(
        _emb(t).select(F.col("vec_id").alias("doc_id"), (F.col("label") % 3).alias("source")), "doc_id")
    return V.balanced_by_source(hits, "source", k=5, n_sources=3)


@query("o05_centroids", f"WITH {CENTROID_SQL} SELECT query_id AS label, centroid FROM c")
def o05_centroids(spark, sf):
    return V.centroids(_emb(Tables(spark, sf)), "embedding", ["label"])


@query("o06_mmr")
def o06_mmr(spark, sf):
    t = Tables(spark, sf)
    return V.mmr(V.knn(_emb(t), _queries(t), k=20), _emb(t), k=5)


@query("o07_lexical_mmr")
def o07_lexical_mmr(spark, sf):
    b = Tables(spark, sf).benchmark
    lists = b.select((F.col("item_id") % 4).alias("list_id"), F.col("item_id").alias("doc_id"), "text",
                     (F.col("item_id") / 4).cast("int").alias("pos"))
    return V.lexical_mmr(lists, k=5)


@query("o08_rank_fusion", """WITH a AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank
  FROM part QUALIFY rank <= 20),
b AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20),
l AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf_score, count(*) AS lists FROM l GROUP BY doc_id""")
def o08_rank_fusion(spark, sf):
    p = Tables(spark, sf).part
    lists = V.ranked_list(p, "p_partkey", "p_retailprice", "price", 20).unionByName(
        V.ranked_list(p, "p_partkey", "p_size", "size", 20))
    return V.rrf(lists)


@query("o09_retrieval_confidence")
def o09_retrieval_confidence(spark, sf):
    t = Tables(spark, sf)
    hits = V.knn(_emb(t), _queries(t), k=5).join(
        _emb(t).select(F.col("vec_id").alias("doc_id"), (F.col("label") % 3).alias("source")), "doc_id")
    return V.retrieval_confidence(hits, "source", 5)


@query("o10_hybrid_keyword")
def o10_hybrid_keyword(spark, sf):
    d = Tables(spark, sf).documents
    q = "the data of report"
    kw = V.bm25(d, "text", "doc_id", q)
    lists = V.ranked_list(kw, "doc_id", "bm25", "bm25", 50).unionByName(
        V.ranked_list(d, "doc_id", "n_chars", "length", 50))
    return V.rrf(lists)

"""Vectors and retrieval.

Exact search never materialises query x corpus pairs: blocks of queries of a
fixed size are sent to a ``mapInPandas`` over the corpus, each
task keeps its own top-k per query with a NumPy matmul, and a salted top-k
merges the per-task candidates.
"""

from __future__ import annotations

from collections.abc import Sequence


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from kestrel.plans.distributed import top_k_per_group

QUERY_BLOCK = 2_000  # queries that go to the tasks at once


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a, b) -> Column:
    """O1: cosine similarity, 0 when either norm is 0; null when dims differ."""
    na, nb = norm(a), norm(b)
    return F.when(F.size(_c(a)) != F.size(_c(b)), F.lit(None)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        dot(a, b) / (na * nb))


def l2_similarity(a, b) -> Column:
    """O1: 1 / (1 + Euclidean distance)."""
    d = F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return F.when(F.size(_c(a)) != F.size(_c(b)), F.lit(None)).otherwise(1 / (1 + d))


def centroids(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean vector (per group): posexplode, average per
    position, re-assembled in position order."""
    e = df.select(*by, F.posexplode(vec).alias("_i", "_v"))
    m = e.groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    return m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_s")).select(
        *by, F.transform("_s", lambda s: s["_m"]).alias("centroid"))


def _topk_task(queries: pd.DataFrame, qkey: str, qvec: str, ckey: str, cvec: str, k: int, metric: str):
    qids = queries[qkey].to_numpy()
    Q = np.stack(queries[qvec].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
    qn = np.linalg.norm(Q, axis=1)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            C = np.stack(pdf[cvec].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
            ids = pdf[ckey].to_numpy()
            if metric == "l2":
                d2 = (qn[:, None] ** 2) + (np.linalg.norm(C, axis=1)[None, :] ** 2) - 2 * Q @ C.T
                score = 1.0 / (1.0 + np.maximum(d2, 0.0))
            elif metric == "dot":
                score = Q @ C.T
            else:
                cn = np.linalg.norm(C, axis=1)
                den = qn[:, None] * cn[None, :]
                score = np.where(den > 0, (Q @ C.T) / np.where(den > 0, den, 1.0), 0.0)
            kk = min(k, score.shape[1])
            least = np.partition(score, score.shape[1] - kk, axis=1)[:, score.shape[1] - kk]
            qi, ci = np.nonzero(score >= least[:, None])  # ties at rank k included, then cut by id
            by = np.lexsort((ids[ci], -score[qi, ci], qi))
            qi, ci = qi[by], ci[by]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
            qi, ci = qi[place < kk], ci[place < kk]
            yield pd.DataFrame({"query_id": qids[qi], "doc_id": ids[ci], "score": score[qi, ci]})
    return run


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", threshold: float | None = None,
        ckey: str = "vec_id", cvec: str = "embedding", qkey: str = "query_id", qvec: str = "embedding") -> DataFrame:
    """O2/O3: exact top-k per query over the whole corpus.  ``metric`` cosine
    (O2), dot, or l2 (O3: score 1 / (1 + squared distance), as the flat L2
    index).  Queries go to the tasks in blocks of about QUERY_BLOCK rows, one
    scan of the corpus each; per-task candidates (k per query per task) are
    merged."""
    asked = queries.select(qkey, qvec)
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kt = corpus.schema[ckey].dataType.simpleString()
    qt = queries.schema[qkey].dataType.simpleString()
    schema = f"query_id {qt}, doc_id {kt}, score double"
    cand = None
    for block in range(n_blocks):
        own = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64(qkey), F.lit(n_blocks)) == block)
        qpdf = own.toPandas()
        if len(qpdf):
            part = corpus.select(ckey, cvec).mapInPandas(_topk_task(qpdf, qkey, qvec, ckey, cvec, k, metric), schema)
            cand = part if cand is None else cand.unionByName(part)
    if cand is None:
        cand = corpus.sparkSession.createDataFrame([], schema)
    top = top_k_per_group(cand, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, out="rank")
    if threshold is not None:
        top = top.where(F.col("score") >= threshold)
    return top


def balanced_by_source(hits: DataFrame, source: str, k: int, n_sources: int) -> DataFrame:
    """At most max(2, k // sources + 1) hits per (query, source), then the
    best 2k overall per query."""
    per = max(2, k // max(n_sources, 1) + 1)
    w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "doc_id")  # hits are k per query
    kept = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r", "rank")
    w2 = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return kept.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= 2 * k)


def _mmr(lam: float, k: int, qkey: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        V = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        nrm = np.linalg.norm(V, axis=1)
        nrm[nrm == 0] = 1.0
        U = V / nrm[:, None]
        sim = U @ U.T
        rel = pdf["score"].to_numpy()
        chosen: list[int] = []
        left = list(range(len(pdf)))
        while left and len(chosen) < k:
            if chosen:
                red = sim[np.ix_(left, chosen)].max(axis=1)
            else:
                red = np.zeros(len(left))
            val = lam * rel[left] - (1 - lam) * red
            best = left[int(np.argmax(val))]
            chosen.append(best)
            left.remove(best)
        out = pdf.loc[chosen, [qkey, "doc_id", "score"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype="int32")
        return out
    return run


def mmr(hits: DataFrame, corpus: DataFrame, k: int = 5, lam: float = 0.7, ckey: str = "vec_id",
        cvec: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over each query's candidates (a bounded
    group: the top-k hits, <= 50), greedy lambda rel - (1 - lambda) max sim."""
    j = hits.join(corpus.select(F.col(ckey).alias("doc_id"), F.col(cvec).alias("embedding")), "doc_id")
    qt = hits.schema["query_id"].dataType.simpleString()
    dt = hits.schema["doc_id"].dataType.simpleString()
    return j.groupBy("query_id").applyInPandas(_mmr(lam, k, "query_id"),
                                               f"query_id {qt}, doc_id {dt}, score double, mmr_rank int")


def _lexical_mmr(lam: float, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        toks = [set(str(t).lower().split()) for t in pdf["text"]]
        rel = 1.0 / (pdf["pos"].to_numpy() + 2.0)
        chosen, left = [], list(range(len(pdf)))
        while left and len(chosen) < k:
            def red(i):
                return max((len(toks[i] & toks[j]) / max(len(toks[i] | toks[j]), 1) for j in chosen), default=0.0)
            vals = [lam * rel[i] - (1 - lam) * red(i) for i in left]
            best = left[int(np.argmax(vals))]
            chosen.append(best)
            left.remove(best)
        out = pdf.loc[chosen, ["list_id", "doc_id"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype="int32")
        return out
    return run


def lexical_mmr(lists: DataFrame, k: int = 5, lam: float = 0.7) -> DataFrame:
    """Rerank each list's (bounded) candidates by relevance 1/(pos+2)
    minus Jaccard word overlap with already chosen texts."""
    lt = lists.schema["list_id"].dataType.simpleString()
    dt = lists.schema["doc_id"].dataType.simpleString()
    return lists.groupBy("list_id").applyInPandas(_lexical_mmr(lam, k), f"list_id {lt}, doc_id {dt}, mmr_rank int")


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum over lists of 1 / (k + rank)."""
    return lists.groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"),
                                       F.count(F.lit(1)).alias("lists"))


def retrieval_confidence(hits: DataFrame, source: str | None = None, k: int = 5) -> DataFrame:
    """0.35 top score + 0.25 mean score + 0.25 coverage (hits / k) +
    0.15 diversity (distinct sources / hits, 1 without sources)."""
    div = F.count_distinct(source) / F.count(F.lit(1)) if source else F.lit(1.0)
    g = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.avg("score").alias("avg"),
                                     F.least(F.count(F.lit(1)) / k, F.lit(1.0)).alias("coverage"), div.alias("diversity"))
    return g.withColumn("confidence", 0.35 * F.col("top") + 0.25 * F.col("avg") + 0.25 * F.col("coverage")
                        + 0.15 * F.col("diversity"))


def bm25(docs: DataFrame, text: str, key: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """O10 keyword side: BM25 of every document for the query terms (term
    frequencies by explode + group-by, document frequency per term)."""
    import re
    terms = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    tok = docs.select(key, F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+").alias("toks"))
    lens = tok.select(key, F.size("toks").alias("dl"))
    avgdl = lens.agg(F.avg("dl")).scalar()
    n = lens.agg(F.count(F.lit(1))).scalar()
    tf = tok.select(key, F.explode("toks").alias("t")).where(F.col("t").isin(terms)).groupBy(key, "t").agg(
        F.count(F.lit(1)).alias("tf"))
    df_t = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    j = tf.join(F.broadcast(df_t), "t").join(lens, key)  # df_t: one row per query term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return j.groupBy(key).agg(F.sum(s).alias("bm25"))


def ranked_list(df: DataFrame, key: str, score: str, list_id: str, top: int) -> DataFrame:
    """Top ``top`` rows of one scored table as a ranked list (list_id, rank, doc_id)."""
    t = df.orderBy(F.desc(score), key).limit(top)
    return t.select(F.lit(list_id).alias("list_id"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"),
                    F.col(key).alias("doc_id"))




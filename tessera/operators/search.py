"""Hybrid search in a few bounded jobs: the keyword leg on postings, one scan of the vectors, and a lookup of the candidates.

Only candidates come to the driver: at most 3 * max(50, 20 * limit) of the keyword leg and `limit` of the vector leg.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fts, ranking
from .filters import SearchFilter
from .index import Index
from .vector import dot, top_documents

#: DataFrame (doc_id, path, content, score) -> the same, reranked.
Reranker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SearchOptions:
    """limit: rows; threshold: least score; filter_scope: whether `where` also holds for the vector leg ("both") or for the
    keyword leg only ("keyword"); doc_filter: vector candidates come from that many documents with the nearest document vectors
    (0: from all); weights: overrides of the keyword and the vector weight."""

    limit: int = 5
    threshold: float = 0.0
    filter_scope: str = "both"
    doc_filter: int = 0
    keyword_weight: float = 0.0
    vector_weight: float = 0.0
    now: str | None = None


def hybrid_search(docs: DataFrame, vectors: DataFrame, index: Index, query: str, query_vector: list[float] | None, options: SearchOptions = SearchOptions(), where: SearchFilter | None = None, reranker: Reranker | None = None, doc_vectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, score): keyword legs and the nearest vectors outside them, fused, boosted, normalised and made diverse by path.

    docs has doc_id, path, age and what `where` needs; vectors has doc_id and v (and path, for doc_filter). Without a keyword match
    or with an empty query only vectors count; without a query vector only keywords.
    """
    spark = docs.sparkSession
    compiled = fts.compile_query(query)
    kw_weight, vec_weight = ranking.override(*ranking.weights(query), options.keyword_weight, options.vector_weight)
    limit = options.limit
    candidates = max(50, 20 * limit)
    allowed = docs.where(where.predicate()).select("doc_id") if where and where.is_set else None
    # bounded: 3 * candidates rows
    kw = {r["doc_id"]: r["kw_rank"] for r in fts.keyword_ranks(index, spark, compiled, candidates, allowed).collect()}
    pool = {d: (r, 0.0) for d, r in kw.items()}
    only: dict[int, float] = {}
    if query_vector:
        rows = vectors
        if options.doc_filter and doc_vectors is not None:
            near = top_documents(doc_vectors, query_vector, options.doc_filter)
            if names := [r["path"] for r in near.collect()]:  # bounded by doc_filter; no document vector, no filter
                rows = rows.where(F.col("path").isin(names) | F.col("doc_id").isin(list(kw)))
        if allowed is not None and options.filter_scope == "both":
            rows = rows.join(allowed, "doc_id", "left_semi")
        q = F.array(*(F.lit(float(x)) for x in query_vector))
        sims = rows.select("doc_id", F.round(dot(F.col("v"), q), 6).alias("sim"), F.col("doc_id").isin(list(kw)).alias("is_kw"))
        # one scan: all keyword candidates and the best others; each task keeps that many of each before the shuffle
        best = sims.withColumn("r", F.row_number().over(Window.partitionBy("is_kw").orderBy(F.desc("sim"), "doc_id"))).where(F.col("r") <= max(limit, len(kw)))
        for r in best.where(F.col("is_kw") | (F.col("r") <= limit)).collect():
            if r["is_kw"]:
                pool[r["doc_id"]] = (kw[r["doc_id"]], r["sim"])
            else:
                only[r["doc_id"]] = r["sim"]
    pool |= {d: (0, s) for d, s in only.items()}
    ranked = sorted(pool, key=lambda d: (-pool[d][1], pool[d][0], d))
    has_vec = bool(only) or any(s != 0 for _, s in pool.values())
    rows = [(d, pool[d][0], i) for i, d in enumerate(ranked, 1)]
    few = spark.createDataFrame(rows, "doc_id long, kw_rank int, vec_rank int")
    meta = docs.where(F.col("doc_id").isin(ranked)).join(F.broadcast(few), "doc_id")
    raw = ranking.rrf(kw_weight, vec_weight) + ranking.recency(F.col("age")) + ranking.path_boost(F.col("path"), list(compiled.bare))
    score = F.round(raw / ranking.most(kw_weight, vec_weight, F.lit(bool(kw)), F.lit(has_vec), bool(compiled.bare)), 6)
    columns = ["doc_id", "path", *(["text"] if reranker else [])]
    out = ranking.diverse(meta.select(*columns, score.alias("score")), "path", "score", "doc_id", limit)
    if reranker:
        out = reranker(out).select("doc_id", "path", "score")
    return out.where(F.col("score") >= options.threshold) if options.threshold > 0 else out

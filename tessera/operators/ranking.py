"""Fusion of keyword and vector ranks, boosts, normalisation and diversity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF = 60
HALF_LIFE = 7 * 86400.0


def weights(query: str) -> tuple[float, float]:
    """(keyword, vector) weights by the number of words and of identifiers among them."""
    words = query.split()
    n = len(words)
    ids = sum(bool(re.search(r"[a-z][A-Z]", w) or ("_" in w and w != "_") or "." in w) for w in words)
    if n <= 2 and ids == n:
        return 1.5, 0.6
    if n == 1:
        return 1.2, 0.9
    if ids > n // 2:
        return 1.3, 0.8
    return (0.7, 1.4) if n >= 4 else (1.0, 1.0)


def override(kw: float, vec: float, keyword: float = 0.0, vector: float = 0.0) -> tuple[float, float]:
    """Weights with an override of one, the other keeping the ratio; the vector's is applied last."""
    if keyword > 0:
        kw, vec = keyword, vec * keyword / kw
    if vector > 0:
        kw, vec = kw * vector / vec, vector
    return kw, vec


def rrf(kw: float, vec: float) -> Column:
    return vec / (RRF + F.col("vec_rank")) + F.when(F.col("kw_rank") > 0, kw / (RRF + F.col("kw_rank"))).otherwise(0.0)


def recency(age: Column) -> Column:
    """0.3 for a new document, half of it after a week; none for an unknown time."""
    return F.coalesce(0.3 * F.exp(-0.693 * F.greatest(age, F.lit(0)) / HALF_LIFE) / (RRF + 1), F.lit(0.0))


def path_boost(path: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit |= F.lower(path).contains(t)
    return F.when(hit, 1.0 / (RRF + 1)).otherwise(0.0)


def most(kw: float, vec: float, has_kw: Column, has_vec: Column, has_terms: bool) -> Column:
    """The greatest score that is possible, to divide by."""
    return (F.when(has_kw, kw).otherwise(0.0) + F.when(has_vec, vec).otherwise(0.0) + 0.3 + float(has_terms)) / (RRF + 1)


def diverse(ranked: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The best row of each key first, then the others by score, to k rows."""
    rows = ranked.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))
    return rows.orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), F.desc(score), tie).limit(k).drop("nth")

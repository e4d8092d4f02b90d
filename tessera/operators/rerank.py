"""Signals, weight profiles and rerankers: what may change the order of a result."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.queries import extension
from .ranking import HALF_LIFE, RRF


@dataclass(frozen=True)
class Profile:
    keyword: float
    vector: float
    recency: float
    path: float


PROFILES = {"code": Profile(1.3, 0.8, 0.3, 1.0), "prose": Profile(0.7, 1.4, 0.2, 0.5), "mixed": Profile(1.0, 1.0, 0.3, 0.8), "balanced": Profile(1.0, 1.0, 0.15, 1.0)}


def profile(name: str = "") -> Profile:
    """The weights of a name; without one those of "balanced"."""
    if (name or "balanced") not in PROFILES:
        raise ValueError(f"unknown weight profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name or "balanced"]


#: A signal is a column over kw_rank, vec_rank, age and path.
Signal = Callable[[Profile, list[str]], Column]


def keyword_signal(p: Profile, terms: list[str]) -> Column:
    return F.when(F.col("kw_rank") > 0, p.keyword / (RRF + F.col("kw_rank"))).otherwise(0.0)


def vector_signal(p: Profile, terms: list[str]) -> Column:
    return F.when(F.col("vec_rank") > 0, p.vector / (RRF + F.col("vec_rank"))).otherwise(0.0)


def recency_signal(p: Profile, terms: list[str]) -> Column:
    return F.coalesce(p.recency * F.exp(-0.693 * F.greatest(F.col("age"), F.lit(0)) / HALF_LIFE) / (RRF + 1), F.lit(0.0))


def path_signal(p: Profile, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit |= F.lower("path").contains(t)
    return F.when(hit, p.path / (RRF + 1)).otherwise(0.0)


def file_type_signal(boosts: dict[str, float], default: float = 0.0) -> Signal:
    """A boost by extension; it is in no registry unless it is added."""

    def signal(p: Profile, terms: list[str]) -> Column:
        out = F.lit(default)
        for ext, boost in boosts.items():
            out = F.when(extension(F.col("path")) == ext, boost).otherwise(out)
        return out / (RRF + 1)

    return signal


@dataclass
class Signals:
    """A registry: the score of a row is the sum of its signals."""

    by_name: dict[str, Signal] = field(default_factory=lambda: {"keyword": keyword_signal, "vector": vector_signal, "recency": recency_signal, "path_match": path_signal})

    def register(self, name: str, signal: Signal) -> None:
        self.by_name[name] = signal

    def score(self, weights: Profile, terms: list[str]) -> Column:
        out = F.lit(0.0)
        for signal in self.by_name.values():
            out = out + signal(weights, terms)
        return out


def parse_scores(answer: str, expected: int) -> list[float]:
    """The numbers of the JSON array in an answer, clamped to 0..1; 0.5 for what is absent or can't be read."""
    start, end = answer.find("["), answer.rfind("]")
    try:
        raw = json.loads(answer[start : end + 1]) if 0 <= start < end else []
        values = [min(1.0, max(0.0, float(x))) for x in raw]
    except (ValueError, TypeError):
        values = []
    return (values + [0.5] * expected)[:expected]


def cross_encoder(query: str, complete: Callable[[str, list[str]], str], top: int = 20, weight: float = 0.5, batch: int = 8, document_bytes: int = 800) -> Callable[[DataFrame], DataFrame]:
    """A reranker of the first `top` rows by a model: `complete` gets the query and a batch of texts and answers with a JSON array.

    Old and new scores are each divided by their maximum and blended; the order is stable; rows after the first
    `top` follow with their old scores. If the model fails the order stays. At most `top` rows reach it.
    """

    def score(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        for i in range(0, len(texts), batch):
            some = [(t or "").encode()[:document_bytes].decode("utf-8", "ignore") for t in texts[i : i + batch]]
            out += parse_scores(complete(query, some), len(some))
        return pd.Series(out, index=texts.index)

    def rerank(results: DataFrame) -> DataFrame:
        rows = results.orderBy(F.desc("score"), "doc_id").limit(top).toPandas()  # at most `top` rows
        if len(rows) < 2:
            return results
        try:
            new = score(rows["text"])
        except Exception:  # noqa: BLE001 - a model that fails leaves the order as it is
            return results
        scores = results.sparkSession.createDataFrame([(int(d), float(s)) for d, s in zip(rows["doc_id"], new)], "doc_id long, _model double")
        return blend(results.join(F.broadcast(scores), "doc_id", "left"), "_model", weight).drop("_model")

    return rerank


def blend(results: DataFrame, model: str, weight: float = 0.5) -> DataFrame:
    """Scores blended with those of a model column (null: not scored, last, with the old score), each divided by its maximum."""
    whole = Window.partitionBy(F.lit(0))  # a result's rows
    scored = F.col(model).isNotNull()
    old_most = F.max(F.when(scored, F.col("score"))).over(whole)
    new_most = F.max(model).over(whole)
    ratio = lambda x, most: F.when(most == 0, x).otherwise(x / most)
    both = (1 - weight) * ratio(F.col("score"), old_most) + weight * ratio(F.col(model), new_most)
    place = F.row_number().over(whole.orderBy(F.desc("score"), "doc_id"))
    rows = results.withColumn("_old", place).withColumn("_score", F.round(F.when(scored, both).otherwise(F.col("score")), 9))
    return rows.orderBy(F.when(F.col(model).isNull(), 1).otherwise(0), F.when(F.col(model).isNull(), 0.0).otherwise(-F.col("_score")), "_old").withColumn("score", F.col("_score")).drop("_old", "_score")


def spread_over_paths(results: DataFrame, seed_path: Column, limit: int) -> DataFrame:
    """Rows (doc_id, path, score) in order of score that have a path not seen before, or are among the first limit / 2 kept; the
    seed's path is seen. All rows where none is kept. A fold over at most `limit` rows."""
    ordered = results.orderBy(F.desc("score"), "doc_id").limit(limit)
    one = ordered.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "path", "score"))).alias("all"))
    item = "struct<s: double, doc_id: bigint, path: string, score: double>"
    start = F.struct(F.array(seed_path).alias("seen"), F.array().cast(f"array<{item}>").alias("kept"))
    step = lambda acc, x: F.when(
        ~F.array_contains(acc["seen"], x["path"]) | (F.size(acc["kept"]) < limit // 2),
        F.struct(F.concat(acc["seen"], F.array(x["path"])).alias("seen"), F.concat(acc["kept"], F.array(x)).alias("kept")),
    ).otherwise(acc)
    folded = one.select("all", F.aggregate("all", start, step)["kept"].alias("kept"))
    rows = folded.select(F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("all"))).alias("position", "r"))
    return rows.select("position", "r.doc_id", "r.path", "r.score")


def with_parents(results: DataFrame, chunks: DataFrame, most: int = 500) -> DataFrame:
    """Results (doc_id, parent_id, ...) with the text of their parents, cut to `most` characters with an ellipsis; null without a parent."""
    parents = chunks.select(F.col("doc_id").alias("_parent"), F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text")).alias("parent_text"))
    return results.join(parents, results["parent_id"] == parents["_parent"], "left").drop("_parent")

"""Keyword search: query compilation, matching on postings, BM25 and the ranked legs.

A query becomes units: quoted phrases, tokens, a prefix of the last token and the parts of identifiers. Content
tokens are stems, so a unit is a sequence of stems, of which the last may be a prefix. All legs are computed from one read of
the postings of the query's stems.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.stemming import stems
from .index import Index, raw_tokens

K1, B = 1.2, 0.75
NEAR_WINDOW = 10
tokens = raw_tokens


def split_identifier(word: str) -> list[str]:
    """Lower-case parts of a snake_case or camelCase word; none if it has one part only."""
    parts = [p for p in word.split("_") if p] if "_" in word else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word).split()
    return [p.lower() for p in parts] if len(parts) > 1 else []


@dataclass(frozen=True)
class Unit:
    """Stems that follow one another; the last one may be a prefix."""

    source: str
    stems: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """The compiled forms of a query as text, the tokens written in it, and its units in order of their text."""

    parts: tuple[str, ...]
    bare: tuple[str, ...]

    @property
    def all_of(self) -> str:
        return " AND ".join(self.parts)

    @property
    def any_of(self) -> str:
        return " OR ".join(self.parts)

    @property
    def near(self) -> str:
        return f"NEAR({' '.join(self.bare)}, {NEAR_WINDOW})" if 2 <= len(self.bare) <= 4 else ""

    @property
    def units(self) -> list[Unit]:
        """What is matched and scored; parts without a content token match nothing and don't count."""
        out = [Unit(p, tuple(stems(p.strip('"').removesuffix("*"))), p.endswith("*")) for p in self.parts]
        return [u for u in out if u.stems]

    @property
    def near_units(self) -> list[Unit]:
        out = [Unit(t, tuple(stems(t))) for t in self.bare] if self.near else []
        return out if all(u.stems for u in out) else []


def compile_query(text: str) -> Query:
    """Phrases in quotes, then words in order of appearance without repeats; the last bare word also as a prefix; identifiers
    also as a phrase and by their parts. An unmatched quote is left alone."""
    phrases: list[str] = []

    def take(m: re.Match) -> str:
        if words := [w for w in m[1].split() if w not in ("AND", "OR", "NOT", "NEAR")]:
            phrases.append(f'"{" ".join(words)}"')
        return " "

    written = re.findall(r"\w+", re.sub(r'"([^"]*)"', take, text))
    original = {w.lower(): w for w in written}
    bare = list(dict.fromkeys(w.lower() for w in written))
    parts = [*dict.fromkeys(phrases), *bare, *([f"{bare[-1]}*"] if bare else [])]
    for word in bare:
        if pieces := split_identifier(original[word]):
            parts += [f'"{word}"', *pieces]
    return Query(tuple(sorted(dict.fromkeys(parts))), tuple(bare))


def _starts(p: Column, unit: Unit, number: dict[tuple[str, bool], int]) -> Column:
    """Positions at which a unit begins, from a document's positions by stem."""
    own = [p[number[s, unit.prefix and i + 1 == len(unit.stems)]] for i, s in enumerate(unit.stems)]
    back = lambda x, n: F.transform(x, lambda y: y - n)
    return reduce(F.array_intersect, [own[0], *(back(x, i) for i, x in enumerate(own[1:], 1))])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def near_counts(at: pd.Series) -> pd.Series:
    """How many of the sorted positions of each token lie in a stretch that holds all tokens with at most NEAR_WINDOW others between its ends."""
    span = NEAR_WINDOW + 1

    def one(lists: list) -> list[int]:
        each = [np.asarray(x, np.int64) for x in lists]
        if not each or any(not len(x) for x in each):
            return [0] * len(each)
        starts = np.unique(np.concatenate(each))
        for x in each:
            first = np.searchsorted(x, starts)
            starts = starts[(first < len(x)) & (x[np.minimum(first, len(x) - 1)] <= starts + span)]
        if not len(starts):
            return [0] * len(each)
        first = [np.searchsorted(starts, x - span) for x in each]
        return [int(((k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] <= x)).sum()) for k, x in zip(first, each)]

    return at.map(one)


def matched(index: Index, spark: SparkSession, query: Query, with_near: bool = True) -> DataFrame:
    """(doc_id, dl, tf: frequency of each unit, near: that of each bare token inside a NEAR match) of the documents that have any unit."""
    units, near = query.units, query.near_units if with_near else []
    wanted = list(dict.fromkeys((s, u.prefix and i + 1 == len(u.stems)) for u in units + near for i, s in enumerate(u.stems)))
    number = {w: i for i, w in enumerate(wanted)}
    hit = [F.col("term").startswith(s) if prefix else F.col("term") == s for s, prefix in wanted]
    p = index.postings(spark).where(reduce(lambda a, b: a | b, hit))
    simple = {u: number[u.stems[0], u.prefix] for u in units if len(u.stems) == 1}
    places = {number[s, u.prefix and i + 1 == len(u.stems)] for u in [*near, *(u for u in units if u not in simple)] for i, s in enumerate(u.stems)}
    counts = [F.coalesce(F.sum(F.when(h, F.col("tf"))), F.lit(0)).cast("int").alias(f"n{i}") for i, h in enumerate(hit)]
    # positions only of the stems of phrases and NEAR: a few arrays a document
    lists = [F.array_sort(F.flatten(F.collect_list(F.when(h, F.col("positions"))))) if i in places else F.array().cast("array<int>") for i, h in enumerate(hit)]
    rows = p.groupBy("doc_id").agg(F.max("dl").alias("dl"), *counts, F.array(*lists).alias("p"))
    tf = [F.col(f"n{simple[u]}") if u in simple else F.size(_starts(F.col("p"), u, number)) for u in units]
    out = rows.select("doc_id", "dl", F.array(*tf).alias("tf"), (F.array(*(_starts(F.col("p"), u, number) for u in near)) if near else F.array().cast("array<array<int>>")).alias("at"))
    out = out.withColumn("near", near_counts(F.when(F.forall("at", lambda a: F.size(a) > 0), F.col("at")).otherwise(F.array().cast("array<array<int>>"))) if near else F.array().cast("array<int>"))
    return out.drop("at").where(F.exists("tf", lambda x: x > 0))


def bm25(tf: Column, df: list[Column], dl: Column, n_docs: int, avgdl: float) -> Column:
    """The score, the higher the better; units that most documents have weigh 1e-6."""
    total = F.lit(0.0)
    for i, n in enumerate(df):
        f = F.get(tf, F.lit(i)).cast("double")
        idf = F.ln((F.lit(float(n_docs)) - n + 0.5) / (n + 0.5))
        total = total + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))
    return total


def scored(index: Index, spark: SparkSession, query: Query, allowed: DataFrame | None = None, with_near: bool = True) -> DataFrame:
    """(doc_id, score, n_hit, near_score) of all matches; near_score is null where the bare tokens aren't near.

    `allowed` (doc_id) restricts the matches; frequencies are those of the whole index.
    """
    units, near = query.units, query.near_units if with_near else []
    if not units:
        return spark.createDataFrame([], "doc_id long, score double, n_hit int, near_score double")
    rows = matched(index, spark, query, with_near)
    # of the bare tokens df is that of their units, which are among the units
    place = {u.stems: i for i, u in enumerate(units) if not u.prefix}
    df = rows.agg(*(F.count_if(F.col("tf")[i] > 0).cast("double").alias(f"df{i}") for i in range(len(units))))
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    both = rows.crossJoin(F.broadcast(df))  # one row
    score = F.round(bm25(F.col("tf"), [F.col(f"df{i}") for i in range(len(units))], F.col("dl"), index.n_docs, index.avgdl), 10)
    near_score = F.lit(None).cast("double")
    if near:
        value = F.round(bm25(F.col("near"), [F.col(f"df{place[u.stems]}") for u in near], F.col("dl"), index.n_docs, index.avgdl), 10)
        near_score = F.when(F.get("near", F.lit(0)) > 0, value)
    return both.select("doc_id", score.alias("score"), F.size(F.filter("tf", lambda x: x > 0)).alias("n_hit"), near_score.alias("near_score"))


def keyword_ranks(index: Index, spark: SparkSession, query: Query, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, kw_rank): the AND leg, then, if it isn't full, the OR and NEAR legs; the least rank of a document counts.

    A document is a candidate of each leg that it is in, and the best `limit` of each leg are ranked, in one pass. Whether the AND
    leg is full is found first, without positions: a query of common words needs no more, and else few documents
    have all words, so that few are looked at for NEAR.
    """
    n = len(query.units)
    found = scored(index, spark, query, allowed, with_near=False)
    if n and (n == 1 or found.where(F.col("n_hit") == n).limit(limit).count() == limit):
        best = found.where(F.col("n_hit") == n).orderBy(F.desc("score"), "doc_id").limit(limit)
        return best.select("doc_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id")).alias("kw_rank"))
    found = scored(index, spark, query, allowed)
    legs = F.array(F.when(F.col("n_hit") == n, F.struct(F.lit(0).alias("leg"), "score")), F.when(F.lit(n > 1), F.struct(F.lit(1).alias("leg"), "score")), F.when(F.col("near_score").isNotNull(), F.struct(F.lit(2).alias("leg"), F.col("near_score").alias("score"))))
    each = found.select("doc_id", F.explode(F.filter(legs, lambda x: x.isNotNull())).alias("l")).select("doc_id", "l.leg", "l.score")
    # the filter on the rank keeps `limit` rows of a leg in each task before the shuffle
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= limit)
    whole = Window.partitionBy(F.lit(0))  # at most 3 * limit rows
    sizes = best.withColumn("n_and", F.count_if(F.col("leg") == 0).over(whole)).withColumn("n_or", F.count_if(F.col("leg") == 1).over(whole))
    offset = F.when(F.col("leg") == 0, 0).when(F.col("leg") == 1, F.col("n_and")).otherwise(F.col("n_and") + F.col("n_or"))
    kept = sizes.where((F.col("leg") == 0) | (F.col("n_and") < limit))
    return kept.groupBy("doc_id").agg(F.min(F.col("r") + offset).cast("int").alias("kw_rank"))

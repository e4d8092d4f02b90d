"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

The classifier is fitted on a bounded sample of labelled documents (`max_examples` of each class, those
with the least hash of their doc_id). Terms are words and the first 4, 5 and 6 bytes of longer words; all terms of
the examples count, and their document frequencies are counted over all documents. Weights are
(1 + ln tf) * (1 + ln((1 + N) / (1 + df))), of length 1. Terms at least `min_lift` times as frequent in one class weigh
more, by 1 + (likelihood ratio of presence and label) / (2 * ln(terms)); no term is left out.

The index adds the postings of rare terms up exactly; for frequent ones it keeps, for each block of `BLOCK` examples,
the largest weight. The two give a bound for each block; blocks that can't reach a query's k-th best
example are passed over: the result is exact, with cosines compared in units of 1 / SCALE.

Each of the k nearest examples votes with its cosine (1 - distance) against the prior. Votes are
calibrated by a logistic curve that is fitted on the examples themselves, each without its own vote,
weighted by the frequency of the classes. The examples that voted are the evidence.

Scale: three passes over the text (sample, frequencies, scores), no shuffle of text; what is sent to
the executors is bounded by the sample.

Defined cases: null and empty texts and those without a term of any example have no neighbour and the score of an empty
vote; terms that no example has are outside of the space; each row is judged by its own text, also where rows share a
doc_id or have none; rows that share a labelled doc_id give one example, the text with the least hash; labels other than 0
and 1 are no examples; a doc_id with both labels counts as toxic; without examples of both classes every
score is 0. Other columns are ignored, and pass through drop_toxic unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import _release, cut, keep_rows, map_arrow, text_slices
from .textops import stems

PREFIXES = (4, 5, 6)
BLOCK = 32
#: Blocks visited at once, queries searched at once, and the share of the examples that makes a term a frequent one.
VISIT, TOGETHER, FREQUENT = 16, 64, 0.05
#: Scores are compared in units of 1 / SCALE; the low bits hold the row.
SCALE, TIES = 1e6, 22
PRIOR_WEIGHT = 1.0
_U = np.uint64


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of the distinct features of each text, ordered by text and feature."""
    value, owner = stems(texts, PREFIXES)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def known_features(texts: list, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index in the vocabulary, times) of the features of each text that the sorted vocabulary has."""
    owner, value, times = features(texts)
    if not len(vocabulary) or not len(value):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.searchsorted(vocabulary, value)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == value
    return owner[hit], at[hit], times[hit]


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at `begin`."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Block-max inverted index of unit vectors: exact sums over rare terms, block maxima of frequent ones."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int) -> None:
        self.n, self.terms = n_rows, n_terms
        self.blocks = max(1, -(-n_rows // BLOCK))
        df = np.bincount(terms, minlength=n_terms)
        often = df > n_rows * FREQUENT
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        dense = often[terms]
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        self.dense[self.place[terms[dense]], rows[dense]] = weights[dense]
        self.top = self.dense.reshape(-1, self.blocks, BLOCK).max(axis=2, initial=0)
        rows, terms, weights = rows[~dense], terms[~dense], weights[~dense]
        del dense
        order = np.argsort(terms, kind="stable")  # rows are in order
        self.row, self.weight = rows[order].astype(np.int64), weights[order]
        self.begin = np.concatenate([[0], np.cumsum(np.where(often, 0, df))])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the highest positive cosine, ties by row."""
        row, score = self.nearest_of(np.zeros(len(terms), np.int64), terms, weights, 1, k, np.array([without]))
        return row[0][row[0] >= 0], score[0][row[0] >= 0]

    def nearest_of(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of nearest() for n queries, given as (query, term, weight) in order of queries; -1 and 0 where there are fewer than k."""
        width = self.blocks * BLOCK
        place = self.place[terms]
        often = place >= 0
        query = np.zeros((n, len(self.dense)), np.float32)
        query[owner[often], place[often]] = weights[often]
        begin, size = self.begin[terms[~often]], np.diff(self.begin)[terms[~often]]
        at = _spans(begin, size)
        sums = np.bincount(np.repeat(owner[~often] * width, size) + self.row[at], np.repeat(weights[~often], size) * self.weight[at], n * width).reshape(n, width)
        bound = query @ self.top + sums.reshape(n, self.blocks, BLOCK).max(axis=2) + 10 / SCALE
        # scores as integers that also order ties by row; only positive ones count
        best = np.zeros((n, k), np.int64)
        spans = [np.arange(b, min(b + VISIT, self.blocks)) for b in range(0, self.blocks, VISIT)]
        reach = np.stack([bound[:, g].max(axis=1) for g in spans], 1)
        for i in np.argsort(-reach.mean(axis=0), kind="stable"):
            active = np.flatnonzero(reach[:, i] >= (best[:, 0] >> TIES) / SCALE)
            if not len(active):
                continue
            a, b = spans[i][0] * BLOCK, (spans[i][-1] + 1) * BLOCK
            score = np.rint((sums[active, a:b] + query[active] @ self.dense[:, a:b]) * SCALE).astype(np.int64)
            key = np.where(score > 0, score << TIES | ((1 << TIES) - 1 - np.arange(a, b)), 0)
            if without is not None:
                key[np.arange(a, b) == without[active, None]] = 0
            both = np.concatenate([best[active], key], 1)
            best[active] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        best = best[:, ::-1]
        return np.where(best > 0, (1 << TIES) - 1 - (best & ((1 << TIES) - 1)), -1), (best >> TIES) / SCALE


class Model:
    """Examples, frequencies and the calibrated vote."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, base_rate: float, k: int) -> None:
        """Examples have the features (row, term, times), in order of rows; idf has the weight of the label, too."""
        self.vocabulary, self.idf, self.k, self.base = vocabulary, idf, k, base_rate
        weight = self.weigh(row, term, times, len(ids))
        # examples with the same frequent feature of the highest weight share blocks, so that bounds are tight
        often = np.bincount(term, minlength=len(vocabulary))[term] > len(ids) * FREQUENT
        lead = np.full(len(ids), -1)
        by_weight = np.flatnonzero(often)[np.argsort(weight[often], kind="stable")]
        lead[row[by_weight]] = term[by_weight]
        del by_weight, often
        order = np.lexsort((ids, lead))
        back = np.argsort(order).astype(np.int32)
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        by_row = np.argsort(back[row], kind="stable")
        row, term, weight = back[row][by_row], term[by_row], weight[by_row]
        self.index = Index(row, term, weight, len(ids), len(vocabulary))
        self.slope, self.shift = 0.0, -50.0
        if 0 < self.toxic.sum() < len(self.toxic):
            raw = self.vote(*self._search(row, term, weight, len(ids), np.arange(len(ids))))
            share = np.where(self.toxic > 0, base_rate / self.toxic.sum(), (1 - base_rate) / (len(self.toxic) - self.toxic.sum()))
            self.slope, self.shift = _logistic(raw, self.toxic, share * len(self.toxic))

    def weigh(self, owner: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        weight = (1 + np.log(times, dtype=np.float32)) * self.idf[term]
        norm = np.sqrt(np.bincount(owner, weight * weight, n))
        return weight / np.where(norm > 0, norm, 1)[owner]

    def _search(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows, cosine = [np.zeros((0, self.k), np.int64)], [np.zeros((0, self.k))]
        for a in range(0, n, TOGETHER):
            b = min(n, a + TOGETHER)
            s = slice(*np.searchsorted(owner, [a, b]))
            found = self.index.nearest_of(owner[s] - a, term[s], weight[s], b - a, self.k, None if without is None else without[a:b])
            rows.append(found[0])
            cosine.append(found[1])
        return np.concatenate(rows), np.concatenate(cosine)

    def vote(self, rows: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The vote of each row of neighbours; those that are absent have a cosine of 0."""
        toxic = self.toxic[np.maximum(rows, 0)] if len(self.toxic) else np.zeros(rows.shape)
        return ((cosine * toxic).sum(axis=1) + PRIOR_WEIGHT * self.base) / (cosine.sum(axis=1) + PRIOR_WEIGHT)

    def judge(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of texts, and the rows and cosines of their neighbours (row -1: none)."""
        owner, term, times = known_features(texts, self.vocabulary)
        rows, cosine = self._search(owner, term, self.weigh(owner, term, times, len(texts)), len(texts))
        return 1 / (1 + np.exp(-(self.slope * self.vote(rows, cosine) + self.shift))), rows, cosine

    def evidence(self, rows: np.ndarray, cosine: np.ndarray) -> pa.ListArray:
        """The neighbours of each text as a list of (doc_id, toxic, cosine)."""
        some = rows >= 0
        offsets = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(self.ids[rows[some]], pa.int64()), pa.array(self.toxic[rows[some]].astype(np.int32)), pa.array(np.round(cosine[some], 6))], ["doc_id", "toxic", "cosine"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def score(self, texts: list) -> tuple[np.ndarray, list[list[dict]]]:
        """Calibrated scores and evidence of texts."""
        score, rows, cosine = self.judge(texts)
        return score, self.evidence(rows, cosine).to_pylist()


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in a little so that separable data have a finite fit."""
    positive = float(label.sum())
    negative = len(label) - positive
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    design = np.stack([x, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (target - p)) - 1e-3 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 2000, k: int = 15, min_lift: float = 2.0) -> Model:
    """The classifier, from the documents that have a label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = known.agg(F.avg("toxic").alias("r"), F.count("*").alias("n")).first()
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for t in (0, 1)]
    # at most 2 * max_examples rows, before and after the join
    labelled = _texts(docs).where("text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sample = cut(labelled.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).repartition(16, "doc_id"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                owner, value, times = features(part.column("text").to_pylist())
                bounds = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (value.view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], names=["doc_id", "toxic", "features", "times"])

    got = map_arrow(sample, vectors, "doc_id long, toxic int, features array<long>, times array<int>").toArrow().combine_chunks()
    ids, toxic = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy()
    sizes = np.array([len(x) for x in got.column("times")], np.int64)
    row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    value, times = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in got.column(name).chunks)]) for name in ("features", "times"))
    vocabulary, term = np.unique(value.view(_U), return_inverse=True)
    term = term.astype(np.int32)
    lean = _label_weight(np.bincount(term, toxic[row], len(vocabulary)), np.bincount(term, minlength=len(vocabulary)), float(toxic.sum()), float(len(toxic)), min_lift)
    del got, value
    _release()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in text_slices(batch):
                seen += np.bincount(known_features(part.column("text").to_pylist(), vocabulary)[1], minlength=len(vocabulary))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[rows], seen[some]]))], names=["term", "df"])

    df = np.zeros(len(vocabulary) + 1, np.int64)
    sums = map_arrow(_texts(docs), frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[sums.column("term").to_numpy() + 1] = sums.column("df").to_numpy()
    idf = 1 + np.log((1 + df[0]) / (1 + df[1:]))
    return Model(vocabulary, idf * lean, ids, toxic, row, term, times, float(rates["r"] or 0.0), k)


def _label_weight(toxic: np.ndarray, n: np.ndarray, pos: float, total: float, min_lift: float) -> np.ndarray:
    """How much more each term weighs, from the examples that have it (toxic ones and all)."""
    neg = total - pos
    if not pos or not neg:
        return np.ones(len(n))
    a, b = toxic, n - toxic

    def cell(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    ratio = 2 * (cell(a, n * pos / total) + cell(b, n * neg / total) + cell(pos - a, (total - n) * pos / total) + cell(neg - b, (total - n) * neg / total))
    more, less = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1)
    return np.where(np.maximum(more / less, less / more) >= min_lift, 1 + np.maximum(ratio, 0) / (2 * math.log(max(2, len(n)))), 1.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_examples: int = 2000, k: int = 15) -> DataFrame:
    """(doc_id, toxicity, toxic, evidence) for every row of docs; evidence lists the examples that voted, nearest first."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                score, rows, cosine = sent.value.judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(score, 6)), pa.array(score >= threshold), sent.value.evidence(rows, cosine)], names=["doc_id", "toxicity", "toxic", "evidence"])

    return map_arrow(_texts(docs), run, "doc_id long, toxicity double, toxic boolean, evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_examples: int = 2000, k: int = 15) -> DataFrame:
    """The rows whose score is under the threshold; columns as in docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples, k))
    place = [c.lower() for c in docs.columns].index("text")
    return keep_rows(docs, lambda part: (sent.value.judge(part.column(place).to_pylist())[0] < threshold).tolist())

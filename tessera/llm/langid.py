"""Language identification by interpolated Kneser-Ney character language models.

For each language of the `lang` column a model of character 5-grams is trained on a bounded sample of its
documents (`max_train`, those with the least hash of their doc_id). The models are stored in sorted
arrays of n-gram hashes, one array for each order, each with the list of the languages that have the n-gram and their
log probabilities: one binary search finds an n-gram in all languages, and a language that lacks it backs off.

A text gets the language with the lowest cross-entropy, in nats a character over the whole text. It is
rejected where that is above what the language's own texts of that length reach: the limit is the mean
of `max_held_out` other documents plus z standard deviations, whose variance is a + b / length; z is the
quantile 1 - `reject_rate` of the held-out documents, and at least 4. A language with fewer than `LEAST` held-out
documents is calibrated by cross-validation on its training documents (in fit, these are then all it has); where that
gives fewer than `LEAST` values, the mean is its own and the variance the largest of the other languages. With fewer
than two documents, or without another language to take the variance from, nothing is accepted as that language.

Only letters and their marks count, in lower case; each run of other characters is one space. Characters from U+0800 on
are hashed into 11 bits.

Scale: two passes without a shuffle of text; the sample and the models are bounded by the parameters: of the values of
`lang`, the `max_languages` with most documents are languages.

Defined cases: a text that is null, empty or without a letter has a null language and cross-entropy and is not
accepted; ties go to the first language by name; with no labelled language every text is rejected; each
row is judged by its own text; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kneser_ney import estimate, lookup
from .runtime import map_arrow, text_slices

N, BITS = 5, 12
#: Texts that are enough to calibrate a language.
LEAST = 8
#: Letters, and the marks that belong to them: vowel signs are part of a word.
_IS_LETTER = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)), bool, 1 << 16)


def letters(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """5-gram keys at every symbol of all texts, and the offset of each text's first one."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    pad = np.zeros(N - 1, np.uint32)
    sizes = np.array([len(x) for x in parts], np.int64)
    code = np.concatenate([y for x in parts for y in (pad, x)]) if texts else pad[:0]
    begin = np.cumsum(sizes + N - 1) - sizes
    is_pad = np.zeros(len(code), bool)
    is_pad[(begin[:, None] - np.arange(1, N)).ravel()] = True
    letter = np.where(code < 1 << 16, _IS_LETTER[np.minimum(code, (1 << 16) - 1)], True)
    symbol = np.where(code < 2048, code, 2048 + (code.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16) & np.uint64(2047)).astype(np.uint32)).astype(np.int64)
    symbol = np.where(letter, symbol, 32)
    symbol[is_pad] = 0
    keep = letter | is_pad
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    keep[1:] |= is_pad[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes + N - 1)[keep]
    symbol, is_pad = symbol[keep], is_pad[keep]
    key = np.zeros(len(symbol), np.int64)
    for k in range(N):
        key[N - 1 - k :] |= symbol[: len(symbol) - (N - 1 - k)] << (BITS * (N - 1 - k)) if k < N - 1 else symbol
    if len(symbol) < N:
        key, owner, is_pad = key[:0], owner[:0], is_pad[:0]
    key, owner = key[~is_pad], owner[~is_pad]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1))


class _Sparse:
    """Sorted keys of several languages, and for each key the languages that have it with a value."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.concatenate([k for k, _ in tables])
        language = np.repeat(np.arange(len(tables)), [len(k) for k, _ in tables])
        order = np.lexsort((language, keys))
        keys, self.language, self.value = keys[order], language[order].astype(np.int32), np.concatenate([v for _, v in tables])[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.begin = keys[head], np.append(head, len(keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in keys, language, value) of all languages that have each key."""
        at = lookup(self.keys, keys)
        hit = np.flatnonzero(at >= 0)
        begin = self.begin[at[hit]]
        size = self.begin[at[hit] + 1] - begin
        entry = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(hit, size), self.language[entry], self.value[entry]


class Models:
    """The models of all languages in shared sorted arrays."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        self.size = 1 << BITS
        models = [estimate(*np.unique(letters(texts[language])[0], return_counts=True), N, BITS, self.size) for language in self.languages]
        self.keys = [_Sparse([(m[k].keys, m[k].logp) for m in models]) for k in range(N if models else 0)]
        self.contexts = [_Sparse([(m[k].contexts, m[k].backoff) for m in models]) for k in range(N if models else 0)]
        self.limits = np.tile([-math.inf, 0.0, 0.0], (len(models), 1))  # mean, a, b of each language, z included
        self.trained = texts

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """log P(last symbol | the four before) for every key and language: from the lowest order up, what an order knows
        replaces the backed-off value of the order below."""
        out = np.full((len(key), len(self.languages)), -math.log(self.size))
        for k in range(N):
            key_k = key & ((1 << BITS * (k + 1)) - 1)
            at, language, value = self.contexts[k].find(key_k >> BITS)
            out[at, language] += value
            at, language, value = self.keys[k].find(key_k)
            out[at, language] = value
        return out

    def cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol of each text (row) under each language, and the number of its symbols; NaN where there is none."""
        key, offsets = letters(texts)
        n = np.diff(offsets)
        out = np.full((len(texts), len(self.languages)), np.nan)
        some = np.flatnonzero(n)
        # a text of nothing but spaces has no letter
        if len(some):
            distinct, place = np.unique(key, return_inverse=True)
            known = self.log_probabilities(distinct)
            total = np.stack([np.add.reduceat(known[:, j][place], offsets[some]) for j in range(len(self.languages))], 1)
            real = np.add.reduceat(((key & ((1 << BITS) - 1)) != 32).astype(np.int64), offsets[some])
            out[some] = np.where(real[:, None] > 0, -total / n[some][:, None], np.nan)
            n[some] = np.where(real > 0, n[some], 0)
        return out, n

    def calibrate(self, texts: dict[str, list[str]], reject_rate: float) -> None:
        """Limits of acceptance from held-out texts of each language."""
        few: dict[int, float] = {}
        for j, language in enumerate(self.languages):
            h, n = self.cross_entropy(texts.get(language, []))
            h, n = h[n > 0, j], n[n > 0]
            if len(h) < LEAST:
                h, n = _cross_validated(self.trained[language])
            if len(h) < 2:
                continue
            mean = float(np.average(h, weights=np.minimum(n, 2000)))
            if len(h) < LEAST:
                few[j] = mean
                continue
            design = np.stack([np.ones(len(n)), 1.0 / n], 1)
            b = max(1e-6, float(np.linalg.lstsq(design, (h - mean) ** 2, rcond=None)[0][1]))
            a = max(1e-6, float(np.median((h - mean) ** 2)))
            z = max(4.0, float(np.quantile((h - mean) / np.sqrt(a + b / n), 1 - reject_rate)))
            self.limits[j] = mean, z * z * a, z * z * b
        known = np.isfinite(self.limits[:, 0])
        if known.any():
            spread = self.limits[known, 1:].max(axis=0)
            for j, mean in few.items():
                self.limits[j] = mean, *spread
        self.trained = {}

    def identify(self, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language or None, cross-entropy, margin to the second, accepted) of each text."""
        if not self.languages:
            nan = np.full(len(texts), np.nan)
            return [None] * len(texts), nan, nan, np.zeros(len(texts), bool)
        h, n = self.cross_entropy(texts)
        filled = np.where(np.isnan(h), math.inf, h)
        best = np.argmin(filled, axis=1)
        low = h[np.arange(len(texts)), best]
        second = np.partition(filled, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), math.inf)
        limit = self.limits[best]
        accepted = (n > 0) & (low <= limit[:, 0] + np.sqrt(limit[:, 1] + limit[:, 2] / np.maximum(1, n)))
        return [self.languages[j] if k else None for j, k in zip(best, n)], low, np.where(np.isfinite(second), second - low, np.nan), accepted


def _cross_validated(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy and length of each text under a model of the others, in at most LEAST folds."""
    folds = min(LEAST, len(texts))
    h, n = [np.zeros(0)], [np.zeros(0, np.int64)]
    for f in range(folds if folds > 1 else 0):
        rest = [t for i, t in enumerate(texts) if i % folds != f]
        x, size = Models({"": rest}).cross_entropy(texts[f::folds])
        h.append(x[size > 0, 0])
        n.append(size[size > 0])
    return np.concatenate(h), np.concatenate(n)


def fit(docs: DataFrame, max_train: int = 400, max_held_out: int = 400, reject_rate: float = 0.001, max_languages: int = 256) -> Models:
    """Models from labelled documents: of each language those with the least hashes train, the next are held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    most = max_train + max_held_out
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # the least hashes lie below this with near certainty; the window sees little more than the sample
    bound = None
    for language, n in sorted(sizes.items()):
        share = min(1.0, (most + 6 * math.sqrt(most)) / n)
        bound = (F.when if bound is None else bound.when)(F.col("lang") == language, int(share * (1 << 32)))
    if bound is None:
        return Models({})
    near = rows.withColumn("place", place).where(F.col("place") < bound)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))).where(F.col("rank") <= most)
    train: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in ranked.select("lang", "rank", "text").orderBy("lang", "rank").toLocalIterator():
        # of few documents half are held out, of very few none
        n = min(most, sizes[r["lang"]])
        to = train if r["rank"] <= min(max_train, n if n < 2 * LEAST else n // 2) else held
        to.setdefault(r["lang"], []).append(r["text"])
    models = Models(train)
    models.calibrate(held, reject_rate)
    return models


def identify_language(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, language, cross_entropy, margin, accepted) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(x: np.ndarray) -> pa.Array:
            return pa.array(np.round(x, 6), mask=~np.isfinite(x))

        for batch in batches:
            for part in text_slices(batch, limit=1_000_000):
                language, h, margin, accepted = sent.value.identify(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(language, pa.string()), number(h), number(margin), pa.array(accepted)], names=["doc_id", "language", "cross_entropy", "margin", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, language string, cross_entropy double, margin double, accepted boolean")

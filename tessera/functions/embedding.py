"""Embedding of chunks in batches, the cache of query embeddings, summaries, and the models' interfaces."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import text_bounds
from .code import cut_at_boundary

#: Texts -> one vector each.
Embedder = Callable[[list[str]], list[list[float]]]
#: (system, user) -> answer of a language model.
Completer = Callable[[str, str], str]


class PermanentError(Exception):
    """What a retry won't mend."""


class TooLongError(Exception):
    """The input is longer than the model's context."""


def hash_embedder(dims: int = 64) -> Embedder:
    """Unit vectors from hashed words: deterministic, without a model; equal texts have equal vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def with_retries(embed: Embedder, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """Tries again after 0.5, 1, 2, 4 s; halves the batch, or a single text at a boundary, where the input is too long."""

    def run(texts: list[str]) -> list[list[float]]:
        for attempt in range(attempts):
            try:
                return embed(texts)
            except TooLongError:
                if len(texts) > 1:
                    half = len(texts) // 2
                    return run(texts[:half]) + run(texts[half:])
                shorter = cut_at_boundary(texts[0], len(texts[0]) // 2)[0]
                if not shorter:
                    raise
                return run([shorter])
            except PermanentError:
                raise
            except Exception:  # noqa: BLE001 - whatever a provider throws may pass
                if attempt + 1 == attempts:
                    raise
                sleep(min(4.0, 0.5 * 2**attempt))
        raise AssertionError("unreachable")

    return run


def embed_chunks(chunks: DataFrame, embed: Embedder, batch: int = 16) -> DataFrame:
    """chunks (heading, content, ...) with v, in batches; another number of vectors than texts is an error."""
    schema = chunks.drop("v").withColumn("v", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in text_bounds(whole.column("content")):
                part = whole.slice(begin, end - begin)
                headings = part.column("heading").to_pylist() if "heading" in part.schema.names else [""] * len(part)
                texts = [f"{h}\n\n{c}" if h else (c or "") for h, c in zip(headings, part.column("content").to_pylist())]
                vectors: list[list[float]] = []
                for i in range(0, len(texts), batch):
                    got = embed(texts[i : i + batch])
                    if len(got) != len(texts[i : i + batch]):
                        raise ValueError(f"{len(got)} vectors for {len(texts[i : i + batch])} texts")
                    vectors += got
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, "v"])

    return chunks.drop("v").mapInArrow(run, schema)


class BreakerOpen(Exception):
    """The embedder failed too often; it is asked again after a pause."""


@dataclass
class QueryCache:
    """The embeddings of the last queries: one call for equal queries at a time, and a pause after repeated failures."""

    embed: Embedder
    model: str = ""
    size: int = 128
    failures: int = 5
    pause: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _held: OrderedDict[str, list[float]] = field(default_factory=OrderedDict)
    _locks: dict[str, threading.Lock] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _failed: int = 0
    _until: float = 0.0

    def key(self, query: str) -> str:
        return f"{self.model}\0{' '.join(query.split())}"

    def get(self, query: str) -> list[float]:
        key = self.key(query)
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                return self._held[key]
            one = self._locks.setdefault(key, threading.Lock())
        with one:
            with self._lock:
                if key in self._held:
                    return self._held[key]
                if self.clock() < self._until:
                    raise BreakerOpen
            try:
                vector = self.embed([query])[0]
            except Exception:
                with self._lock:
                    self._failed += 1
                    if self._failed >= self.failures:
                        self._until, self._failed = self.clock() + self.pause, 0
                raise
            with self._lock:
                self._failed = 0
                self._held[key] = vector
                self._locks.pop(key, None)
                while len(self._held) > self.size:
                    self._held.popitem(last=False)
            return vector


@dataclass
class RateLimiter:
    """A token bucket with a bound on those who wait."""

    capacity: float = 10
    rate: float = 5
    waiters: int = 100
    clock: Callable[[], float] = time.monotonic
    _tokens: float | None = None
    _at: float = 0.0
    _waiting: int = 0

    def delay(self) -> float:
        """Seconds to wait for the next call; an error where too many wait."""
        now = self.clock()
        tokens = self.capacity if self._tokens is None else min(self.capacity, self._tokens + (now - self._at) * self.rate)
        if tokens < 1 and (1 - tokens) * self.rate > 0 and self._ahead(tokens) >= self.waiters:
            raise RuntimeError("too many callers wait")
        self._tokens, self._at = tokens - 1, now
        return max(0.0, -self._tokens / self.rate)

    def _ahead(self, tokens: float) -> int:
        return int(max(0.0, 1 - tokens))


def summaries(texts: list[str], complete: Completer, batch: int = 4, most: int = 2000, fallback: int = 200) -> list[str]:
    """One summary a text, in batches; a batch that fails is tried text by text, and a text's start stands in for what can't be had."""
    out: list[str] = []
    for i in range(0, len(texts), batch):
        some = [t.encode()[:most].decode("utf-8", "ignore") for t in texts[i : i + batch]]
        got: list[str] = []
        try:
            got = [x.strip() for x in complete("Summarise each text in a line.", "\n\0\n".join(some)).strip().split("\n")]
        except Exception:  # noqa: BLE001
            got = []
        if len(got) != len(some):
            got = []
            for t in some:
                try:
                    got.append(complete("Summarise the text in a line.", t).strip())
                except Exception:  # noqa: BLE001
                    got.append("")
        out += [g or t.encode()[:fallback].decode("utf-8", "ignore") for g, t in zip(got, some)]
    return out

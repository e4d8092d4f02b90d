"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits or non-ASCII characters of the
lower-cased text (regex ``[a-z0-9\\x80-\\U0010FFFF]+``); everything else separates.
Words are represented by 64-bit hashes so that whole Arrow batches are processed by
numpy rather than one Python string at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64
#: Characters that are scanned at once: working memory is about 60 bytes for each.
WORKING = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            with np.errstate(over="ignore"):
                step_up = _U(pow(_MULT, len(self.up), 1 << 64))
                step_down = _U(pow(_INV, len(self.down), 1 << 64))
                self.up = np.concatenate([self.up, self.up * step_up])
                self.down = np.concatenate([self.down, self.down * step_down])
        return self.up, self.down


_powers = _Powers()


class _Scan:
    """Word boundaries of a batch of texts, and hashes of any spans of its bytes."""

    def __init__(self, texts: list) -> None:
        lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n" + b"\n".join(lowered) + b"\n", np.uint8)
        is_word = _WORD[raw]
        edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        up, self.down = _powers.get(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(raw) + 1, _U)
            np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=self.prefix[1:])
        sizes = np.fromiter((len(x) + 1 for x in lowered), np.int64, len(texts))
        self.offsets = np.searchsorted(self.starts, np.concatenate([[1], 1 + np.cumsum(sizes)]))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and for each text the offset of its first word (n + 1 values).

    None and empty texts have no words. Equal words have equal hashes in every batch.
    """
    values, counts = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
    for a, b in slices(texts, WORKING):
        scan = _Scan(texts[a:b])
        values.append(scan.hashes(scan.starts, scan.ends))
        counts.append(np.diff(scan.offsets))
    return np.concatenate(values), np.cumsum(np.concatenate(counts))


def stems(texts: list, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the first bytes of longer words, by each of `lengths`, and the text of each."""
    values, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for a, b in slices(texts, WORKING):
        scan = _Scan(texts[a:b])
        owner = np.repeat(np.arange(a, b), np.diff(scan.offsets))
        values.append(scan.hashes(scan.starts, scan.ends))
        owners.append(owner)
        for n in lengths:
            longer = np.flatnonzero(scan.ends - scan.starts > n)
            starts = scan.starts[longer]
            values.append(mix(scan.hashes(starts, starts + n) ^ _U(n)))
            owners.append(owner[longer])
    return np.concatenate(values), np.concatenate(owners)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-gram hashes by text, sorted within each text, and their offsets.

    A text of 1 to n-1 words has one shingle, of all its words; a text without words has none.
    """
    count = len(offsets) - 1
    lengths = np.diff(offsets)
    grams = mix(hashes)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(hashes), _U)
        for k in range(n):
            shifted = np.zeros(len(hashes), _U)
            shifted[: max(0, len(hashes) - k)] = grams[k:]
            acc = acc * _U(0xD6E8FEB86659FD93) + shifted
    doc = np.repeat(np.arange(count), lengths)
    keep = np.arange(len(hashes)) + n <= offsets[1:][doc]
    value, owner = mix(acc[keep]), doc[keep]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        with np.errstate(over="ignore"):
            tail = np.array([np.sum(grams[offsets[i] : offsets[i + 1]] * (np.arange(lengths[i]).astype(_U) * _U(2) + _U(0x9E3779B97F4A7C15)), dtype=_U) for i in short], _U)
        value, owner = np.concatenate([value, mix(tail)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(count + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        value[a:b].sort()
    if len(value):
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(count + 1))


def slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` characters each; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)

"""Benchmark decontamination with suffix arrays of the training text.

Every Arrow batch of training documents is a shard. Its word suffixes are sorted once (prefix doubling on packed
64-bit keys, `np.sort`), to the depth of `min_words`: deeper order isn't needed to find all places of a passage. Each suffix
of each test text is then binary-searched in the shard's array, one word at a time, within the range that its earlier
words left; the range at `min_words` holds all places that matter, and each is followed word by word, in the whole
document, to the end of its verbatim match. A document that shares at least `min_words` words in sequence with a test
text (or all words of a shorter one) is affected.

Scale: one pass over the text without a shuffle; shards are independent and hold about
`shard_bytes` of text. A document longer than a shard's array is sorted in pieces that overlap by `min_words`. The test texts
are sent in passes of at most `max_benchmark_words` words (or one longer text); a task holds one pass at a time, and
searches all of them in the array that it sorted.

Words are compared in lower case, without punctuation, by 64-bit hashes. Defined cases: null
or empty texts have no match; a test text without words matches nothing; copies of a test
text all match; each row is judged by its own text, also where rows share a doc_id or have none.
Other columns pass through remove_contaminated unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep_rows, map_arrow, text_slices
from .textops import words

MATCHES = "array<struct<item_id: bigint, words: int, doc_word: bigint, item_word: int>>"
_INT = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("doc_word", pa.int64()), ("item_word", pa.int32())]))


def _ranks(sorted_keys: np.ndarray, shift: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, rank of each position (that of the first of its equals) and where rank groups start."""
    order = sorted_keys & np.int64((1 << shift) - 1)
    value = sorted_keys >> np.int64(shift)
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order, rank, starts


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `symbols` (non-negative integers) ordered by their first `depth` symbols or more.

    Suffixes that agree so far keep the order of their positions. At most 2**21 symbols.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    if n > 1 << 21:
        raise ValueError("a shard has at most 2**21 symbols")
    bits = max(1, int(n - 1).bit_length())
    at = np.arange(n, dtype=np.int64)
    order, rank, starts = _ranks(np.sort((symbols.astype(np.int64) << bits) | at), bits, n)
    done = 1
    while done < depth:
        sizes = np.diff(np.append(starts, n))
        open_groups = sizes > 1
        if not open_groups.any():
            break
        # only suffixes that still have an equal are sorted again, inside their places
        slot = np.flatnonzero(np.repeat(open_groups, sizes))
        who = order[slot]
        ahead = who + done
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        packed = np.sort((rank[who] << (2 * bits + 1)) | (second << bits) | who) if 3 * bits + 1 < 63 else None
        if packed is None:
            by = np.lexsort((who, second, rank[who]))
            first, who, second = rank[who][by], who[by], second[by]
        else:
            who = packed & np.int64((1 << bits) - 1)
            second = (packed >> bits) & np.int64((1 << (bits + 1)) - 1)
            first = packed >> (2 * bits + 1)
        order[slot] = who
        new = np.ones(len(who), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(new)
        rank[who] = np.repeat(slot[head], np.diff(np.append(head, len(who))))
        starts = np.union1d(starts, slot[head])
        done *= 2
    return order


def _bound(array: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: int, target: np.ndarray, right: bool) -> np.ndarray:
    """For each range [low, high) of the suffix array, where the symbol `ahead` of its suffixes passes `target`."""
    low, high = low.copy(), high.copy()
    n = len(array)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        at = order[np.minimum(middle, len(order) - 1)] + ahead
        symbol = np.where(at < n, array[np.minimum(at, n - 1)], -1)
        below = (symbol <= target) if right else (symbol < target)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


class Shard:
    """The suffix array of pieces of texts: (document, first word, end), where the words of document d end at offsets[d + 1]."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, pieces: list[tuple[int, int, int]], min_words: int) -> None:
        self.hashes, self.offsets, self.min_words = hashes, offsets, min_words
        self.document, begin, end = (np.array(x, np.int64) for x in zip(*pieces))
        counts = end - begin
        self.first_word = begin
        train = np.concatenate([hashes[b:e] for _, b, e in pieces])
        self.vocabulary, where = _vocabulary(train)
        # a separator ends each piece; it equals no test symbol
        piece = np.repeat(np.arange(len(counts)), counts)
        self.symbols = np.zeros(len(train) + len(counts), np.int64)
        self.symbols[np.arange(len(train)) + piece] = where + 1
        self.begins = np.cumsum(counts) - counts + np.arange(len(counts))
        self.order = suffix_array(self.symbols, min_words)

    def search(self, test: np.ndarray, test_offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, length, document's word, item's word) of each longest match in the shard.

        Hashes and offsets are those of textops.words. One row for each document and item: the
        longest match, the first of several.
        """
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(test):
            return none
        code = np.searchsorted(self.vocabulary, test)
        code[code == len(self.vocabulary)] = 0
        wanted = np.where(self.vocabulary[code] == test, code + 1, -2)
        lengths = np.diff(test_offsets)
        item = np.repeat(np.arange(len(lengths)), lengths)
        start = np.arange(len(test))
        remaining = test_offsets[1:][item] - start
        need = np.minimum(self.min_words, lengths[item])
        active = np.flatnonzero(remaining >= need)
        low, high = np.zeros(len(active), np.int64), np.full(len(active), len(self.order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(self.min_words):
            target = wanted[start[active] + k]
            low, high = _bound(self.symbols, self.order, low, high, k, target, False), _bound(self.symbols, self.order, low, high, k, target, True)
            ok = low < high
            active, low, high = active[ok], low[ok], high[ok]
            ready = need[active] == k + 1
            found.append((active[ready], low[ready], high[ready]))
            active, low, high = active[~ready], low[~ready], high[~ready]
            if not len(active):
                break
        who, low, high = (np.concatenate(x) for x in zip(*found))
        if not len(who):
            return none
        sizes = high - low
        suffix = np.repeat(who, sizes)
        place = self.order[np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        piece = np.searchsorted(self.begins, place, side="right") - 1
        document = self.document[piece]
        word = self.first_word[piece] + place - self.begins[piece]
        end = self.offsets[document + 1]
        length = need[suffix].copy()
        going = np.arange(len(suffix))
        while len(going):
            at, to = word[going] + length[going], start[suffix[going]] + length[going]
            ok = (length[going] < remaining[suffix[going]]) & (at < end[going])
            going, at, to = going[ok], at[ok], to[ok]
            going = going[self.hashes[at] == test[to]]
            length[going] += 1
        best = np.lexsort((word, -length, item[suffix], document))
        pair = document[best] * len(lengths) + item[suffix][best]
        best = best[np.concatenate([[True], pair[1:] != pair[:-1]])]
        return document[best], item[suffix][best], length[best], word[best] - self.offsets[document[best]], start[suffix][best] - test_offsets[item[suffix][best]]


def _vocabulary(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the index of each hash among them."""
    bits = max(1, int(len(hashes) - 1).bit_length())
    # the low bits of a hash give way to its position, so that one sort of values does; full hashes are compared afterwards
    mask = np.uint64((1 << bits) - 1)
    packed = np.sort((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    ranked = hashes[order]
    top = packed & ~mask
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not np.array_equal(new[1:], top[1:] != top[:-1]):  # two words agree in the high bits
        return np.unique(hashes, return_inverse=True)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(new) - 1
    return ranked[new], out


def _test_passes(benchmark: DataFrame, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item_id, hashes, offsets) of the test texts, in passes of about max_words words."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct()
    for row in rows.orderBy("i", "t").toLocalIterator():
        n = len(row["t"].split())
        if texts and size + n > max_words:
            yield np.array([-1 if i is None else i for i in ids], np.int64), *words(texts)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += n
    if texts:
        yield np.array([-1 if i is None else i for i in ids], np.int64), *words(texts)


def _pieces(offsets: np.ndarray, overlap: int, most: int = (1 << 20) - 2) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, first word, end) with fewer than 2**20 words and separators in all.

    A document that is longer comes in pieces that overlap by `overlap` words (at most half a piece), so that no
    passage of as many is lost.
    """
    if 2 * overlap > most:
        raise ValueError("the overlap is at most half a piece")
    held: list[tuple[int, int, int]] = []
    size = 0
    for d in range(len(offsets) - 1):
        begin, end = int(offsets[d]), int(offsets[d + 1])
        while begin < end:
            stop = min(end, begin + most)
            if held and size + stop - begin + 1 > most:
                yield held
                held, size = [], 0
            held.append((d, begin, stop))
            size += stop - begin + 1
            begin = stop if stop == end else stop - overlap
    if held:
        yield held


def match_texts(texts: list, passes: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], min_words: int, most: int = (1 << 20) - 2) -> list[dict[int, dict]]:
    """For each text, its matches by item."""
    hashes, offsets = words(texts)
    out: list[dict[int, dict]] = [{} for _ in texts]
    shards = [Shard(hashes, offsets, pieces, min_words) for pieces in _pieces(offsets, min_words, most)]
    for ids, test, test_offsets in passes:
        for shard in shards:
            for d, i, n, at, item_at in zip(*(x.tolist() for x in shard.search(test, test_offsets))):
                item = int(ids[i])
                old = out[d].get(item)
                if old is None or n > old["words"] or (n == old["words"] and at < old["doc_word"]):
                    out[d][item] = {"item_id": item, "words": n, "doc_word": at, "item_word": item_at}
    return out


def _each(sent: list[Broadcast]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The passes, of which a task holds one at a time; it reads the next from the executor's store."""
    for x in sent:
        yield x.value
        if len(sent) > 1:
            vars(x).pop("_value", None)


def _send(docs: DataFrame, benchmark: DataFrame, max_words: int) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(x) for x in _test_passes(benchmark, max_words)]


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, shard_bytes: int = 5_000_000, max_benchmark_words: int = 2_000_000) -> DataFrame:
    """(doc_id, contaminated, longest_match, matches) for every row of docs.

    matches has one entry for each test text that the document shares at least min_words words in
    sequence with: its item_id (-1 where that is null), the length of the longest match, and the
    word at which the match begins in the document and in the test text, counted from 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = _send(docs, benchmark, max_benchmark_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=shard_bytes):
                found = match_texts(part.column("text").to_pylist(), _each(sent), min_words)
                matches = [[x[i] for i in sorted(x)] for x in found]
                longest = [max((m["words"] for m in x), default=0) for x in matches]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([bool(x) for x in matches]), pa.array(longest, pa.int32()), pa.array(matches, _INT)], names=["doc_id", "contaminated", "longest_match", "matches"])

    return map_arrow(rows, run, f"doc_id long, contaminated boolean, longest_match int, matches {MATCHES}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, shard_bytes: int = 5_000_000, max_benchmark_words: int = 2_000_000) -> DataFrame:
    """The rows that share no passage of min_words words with a test text; columns as in docs."""
    sent = _send(docs, benchmark, max_benchmark_words)

    place = [c.lower() for c in docs.columns].index("text")

    def clean(part: pa.RecordBatch) -> list[bool]:
        return [not x for x in match_texts(part.column(place).to_pylist(), _each(sent), min_words)]

    return keep_rows(docs, clean, shard_bytes)

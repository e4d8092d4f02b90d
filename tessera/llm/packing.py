"""Best-fit packing of documents into sequences of a fixed capacity, with large-item matching.

Lengths are whole numbers up to the capacity, so the packing depends only on how many pieces
there are of each length. The plan is made from that histogram, which has at most `capacity`
rows however many documents there are:

1. A document longer than the capacity gives full pieces and a remainder.
2. Pieces of more than one third of the capacity, at most two of which share a bin: the largest is
   matched greedily with the largest other one that fits beside it.
3. The smaller pieces, from the largest down, each go to the bin with the least gap that holds
   them; where none does, a bin is opened.

Every run of equal pieces is planned at once: a plan row says which ranks of a length go to which bins,
how many to a bin and at which offset. Each piece finds its row by its rank among the pieces of
its length, ordered by hash bucket, doc_id and part (rows with the same doc_id and part are alike).

Scale: one shuffle of (length, doc_id, part), by length and hash bucket of (doc_id, part): a length has a bucket for every
`rank_rows` pieces, so that a frequent length (that of full pieces) is ranked in as many tasks as it needs. The
pieces in earlier buckets of a length are counted and joined in Spark; what comes to the driver is the histogram, of at most
`capacity` rows, and what is sent is the plan, of a few rows for each length.

Length is the number of words between white space, or any integer column. Defined cases: null and
empty texts, and lengths under 1, are in no bin; rows that share a doc_id are packed each, a null
doc_id comes first among its length; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, map_arrow

#: length, first rank, end rank, first bin, pieces in a bin, offset of the first piece in its bin
Plan = list[tuple[int, int, int, int, int, int]]


def plan(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """Plan rows and the number of bins for `histogram[length]` pieces of each length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("a length out of range")
    rank = dict.fromkeys(left, 0)
    rows: Plan = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins), the next to use at the end
    known: list[int] = []  # the gaps that have bins, sorted
    bins = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(known, gap)
            gaps[gap].append((first, count))

    def take(length: int, count: int, first: int, per_bin: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + count, first, per_bin, offset))
        rank[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0 or (large[at] == a and left[a] == 1 and at == 0):
            count = left[a] if at < 0 else 1
            take(a, count, bins, 1, 0)
            put(capacity - a, bins, count)
        elif large[at] == a:
            # a fits beside itself; a lone last one is matched in the next turn, or stays alone
            count = left[a] // 2
            if not count:
                other = at - 1
                while other >= 0 and not left[large[other]]:
                    other -= 1
                take(a, 1, bins, 1, 0)
                if other >= 0:
                    b = large[other]
                    take(b, 1, bins, 1, a)
                    put(capacity - a - b, bins, 1)
                else:
                    put(capacity - a, bins, 1)
                bins += 1
                continue
            take(a, 2 * count, bins, 2, 0)
            put(capacity - 2 * a, bins, count)
        else:
            b = large[at]
            count = min(left[a], left[b])
            take(a, count, bins, 1, 0)
            take(b, count, bins, 1, a)
            put(capacity - a - b, bins, count)
        bins += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(known, n)
            if at == len(known):
                gap, first, count = capacity, bins, -(-left[n] // (capacity // n))
                bins += count
            else:
                gap = known[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    known.pop(at)
            per_bin = gap // n
            full = min(count, left[n] // per_bin)
            if full:
                take(n, full * per_bin, first, per_bin, capacity - gap)
                put(gap - per_bin * n, first, full)
            rest = left[n] if full < count else 0
            if rest:
                take(n, rest, first + full, rest, capacity - gap)
                put(gap - rest * n, first + full, 1)
                full += 1
            put(gap, first + full, count - full)
    return sorted(rows), bins


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.when(text.isNotNull(), F.regexp_count(text, F.lit(r"\S+")))


def pack(docs: DataFrame, capacity: int = 2048, length: Column | None = None, rank_rows: int = 100_000) -> DataFrame:
    """(doc_id, part, n_words, bin_id, bin_offset): where each piece of each document goes.

    part counts the pieces of a document from 0; pieces of one bin don't overlap and end
    within the capacity.
    """
    n = word_count(F.col("text").cast("string")) if length is None else length
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n")).where("n > 0")
    pieces = cut(sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity).cast("long"))).alias("part", "k")).select("doc_id", F.col("part").cast("long").alias("part"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).cast("int").alias("n_words")))
    histogram = {r["n_words"]: r["c"] for r in pieces.groupBy("n_words").agg(F.count("*").alias("c")).collect()}
    rows, _ = plan(histogram, capacity)
    # a foldable array: the buckets of each length
    of_length = F.expr("array(" + ", ".join(str(max(1, -(-histogram.get(k, 0) // rank_rows))) for k in range(capacity + 1)) + ")")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.get(of_length, F.col("n_words"))).cast("int"))
    earlier = Window.partitionBy("n_words").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("n_words", "bucket").agg(F.count("*").alias("c")).select("n_words", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    step = 1 << 40
    table = np.array(rows, np.int64).reshape(-1, 6)
    sent = docs.sparkSession.sparkContext.broadcast((table[:, 0] * step + table[:, 1], table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = sent.value
        for batch in batches:
            size = batch.column("n_words").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64) - 1 + batch.column("before").to_numpy()
            at = np.searchsorted(starts, size * step + rank, side="right") - 1
            row = rows[at] if len(rows) else np.zeros((0, 6), np.int64)
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("n_words"), pa.array(row[:, 3] + nth // row[:, 4]), pa.array((row[:, 5] + nth % row[:, 4] * size).astype(np.int32))], names=["doc_id", "part", "n_words", "bin_id", "bin_offset"])

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("n_words", "bucket").orderBy("doc_id", "part")).cast("long"))
    return map_arrow(ranked.join(before, ["n_words", "bucket"]), place, "doc_id long, part long, n_words int, bin_id long, bin_offset int")

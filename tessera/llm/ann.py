"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is built by k-means with `branching` centres, again in each part, until a leaf stands for about `leaf_size`
vectors. It is fitted on a bounded sample (`max_sample`, those with the least hash of their id, so it has at most
max_sample / 4 leaves); every vector goes down to the leaf of the nearest centres and is indexed there. A query keeps a priority
queue of nodes by the distance to their centres: it descends from the nearest, and each next leaf begins at the nearest
node that was passed by. How many leaves are visited is calibrated: for `calibration` vectors outside of the sample (where
there are others) the exact neighbours among all vectors are found by brute force, and visits are widened until the
leaves visited hold at least `target_recall` of them.

Within the leaves that a query visits distances are exact; the k least, ties by id, are the result; the vector itself is
no neighbour, other rows with the same vector are.

Scale: leaves next to each other share a bucket of about `bucket_size` vectors, and a leaf with more of them (of
equal vectors, say) is divided among several, to all of which its queries go: no task holds more than a bucket. One shuffle of
(bucket, id, vector), each vector once as a point and each query once for each bucket in which it visits leaves, and one
of the k best of each bucket by query. The tree is bounded by the sample and is sent to the executors.

Defined cases: rows with a null id, a null vector, a null or not finite element or another dimension than the
commonest (the least of several) are neither points nor queries; rows that share an id are points each, and
one query, with the least vector; fewer than k other vectors give all of them, no other vector an empty list; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, whole_groups
from .textops import mix


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres of non-empty clusters, and the cluster of each row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        used, label = np.unique(label, return_inverse=True)
        centres = np.stack([x[label == j].mean(0) for j in range(len(used))])
    label = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    return centres, label


class Tree:
    """Centres of all nodes, the children of each and the number of each leaf."""

    def __init__(self, sample: np.ndarray, total: int, branching: int, leaf_size: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        least = max(4, leaf_size * len(sample) / max(1, total))
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        centres: list[np.ndarray] = []
        self.leaves = 0

        def add(rows: np.ndarray, centre: np.ndarray) -> int:
            node = len(centres)
            centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            if len(rows) > max(least, branching):
                own, label = _kmeans(sample[rows], branching, rng)
                if len(np.unique(label)) > 1:
                    self.children[node] = [add(rows[label == j], own[j]) for j in range(len(own)) if (label == j).any()]
            if not self.children[node]:
                self.leaf[node] = self.leaves
                self.leaves += 1
            return node

        add(np.arange(len(sample)), sample.mean(0) if len(sample) else np.zeros(0))
        self.centres = np.stack(centres)
        self.norms = (self.centres**2).sum(1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, less the squared norm of x."""
        return self.norms - 2 * x @ self.centres.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the distances to the children of each node on its way."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            children = self.children[node]
            if not children:
                out[rows] = self.leaf[node]
                continue
            to = np.argmin(self.norms[children] - 2 * x[rows] @ self.centres[children].T, axis=1)
            todo += [(c, rows[to == j]) for j, c in enumerate(children) if (to == j).any()]
        return out

    def visits(self, x: np.ndarray, most: int, ordered: bool = False) -> np.ndarray:
        """The first `most` leaves that a best-bin-first traversal visits, for each vector."""
        if most >= self.leaves and not ordered:
            return np.tile(np.arange(self.leaves), (len(x), 1))
        most = min(most, self.leaves)
        out = np.empty((len(x), most), np.int64)
        for i, d in enumerate(self.distances(x).tolist()):
            queue = [(d[0], 0)]
            for k in range(most):
                node = heapq.heappop(queue)[1]
                while self.children[node]:
                    near = sorted((d[c], c) for c in self.children[node])
                    for other in near[1:]:
                        heapq.heappush(queue, other)
                    node = near[0][1]
                out[i, k] = self.leaf[node]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def _nearest(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, allowed: np.ndarray | None = None, by_row: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of queries, ids or rows, distances) of the k nearest points, of those that are allowed."""
    norms = (points**2).sum(1)
    for begin in range(0, len(queries), 512):
        q = queries[begin : begin + 512]
        d = norms - 2 * q @ points.T + (q**2).sum(1)[:, None]
        d[own[begin : begin + 512][:, None] == ids] = np.inf
        if allowed is not None:
            d[~allowed[begin : begin + 512]] = np.inf
        # the rounding of these distances can't push a neighbour out of twice as many
        m = min(2 * k + 8, len(points))
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(points) else np.tile(np.arange(len(points)), (len(q), 1))
        edge = np.sort(np.take_along_axis(d, near, 1), 1)[:, m - 1]
        for i in range(len(q)):
            rows = near[i] if m == len(points) or np.count_nonzero(d[i] <= edge[i]) == m else np.flatnonzero(d[i] <= edge[i])
            rows = rows[np.isfinite(d[i, rows])]
            exact = np.sqrt(((points[rows] - q[i]) ** 2).sum(1)).round(6)
            best = np.lexsort((ids[rows], exact))[:k]
            yield begin + i, rows[best] if by_row else ids[rows[best]], exact[best]


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def calibration_ranks(rows: DataFrame, tree: Tree, queries: list[tuple[int, list[float]]], k: int) -> list[int]:
    """How many leaves each exact neighbour of the queries (a bounded number) takes to be reached, best bin first."""
    own, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries])
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, points = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            leaf = sent.value.assign(points)
            # an id may occur in several rows: neighbours are found by row, and named by leaf only
            found = [(int(own[r]), float(x), int(leaf[i])) for r, near, d in _nearest(points, ids, q, own, k, by_row=True) for i, x in zip(near, d)]
            a, b, c = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.float64()), pa.array(c, pa.int64())], names=["q", "d", "leaf"])

    def best(of: DataFrame, *keys) -> DataFrame:
        return of.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    parts = map_arrow(rows, run, "q long, d double, leaf long").select("q", F.array(F.struct("d", "leaf")).alias("near"), F.pmod(F.spark_partition_id(), F.lit(256)).alias("part"))
    exact = {r["q"]: [x["leaf"] for x in r["near"]] for r in best(best(parts, "q", "part"), "q").collect()}
    out: list[int] = []
    for (i, _), leaves in zip(queries, tree.visits(q, tree.leaves, True)):
        rank = np.empty(tree.leaves, np.int64)
        rank[leaves] = np.arange(tree.leaves)
        out += rank[exact.get(i, [])].tolist()
    return out


def _placement(counts: np.ndarray, bucket_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first bucket and number of buckets of each leaf, buckets): small leaves share one, large leaves have several."""
    first, pieces = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    bucket = held = 0
    for leaf, n in enumerate(counts.tolist()):
        if n > bucket_size:
            bucket += held > 0
            first[leaf], pieces[leaf] = bucket, -(-n // bucket_size)
            bucket, held = bucket + int(pieces[leaf]), 0
            continue
        if held and held + n > bucket_size:
            bucket, held = bucket + 1, 0
        first[leaf] = bucket
        held += n
    return first, pieces, bucket + 1


def nearest_neighbours(vectors: DataFrame, k: int = 10, queries: DataFrame | None = None, id_column: str = "vec_id", column: str = "embedding", branching: int = 8, leaf_size: int = 128, max_sample: int = 20_000, calibration: int = 128, target_recall: float = 0.97, bucket_size: int = 4096) -> DataFrame:
    """(id, neighbours) for every query (every vector where `queries` is None), among all vectors.

    neighbours lists (id, distance) from the nearest on. `queries` has the columns of `vectors`.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_column, column)
    shape = f"{id_column} long, neighbours array<struct<id: bigint, distance: double>>"
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], shape)
    total = size["n"]
    rows = rows.where(F.size("v") == size["d"])
    asked = (rows if queries is None else _usable(queries, id_column, column).where(F.size("v") == size["d"])).groupBy("id").agg(F.min("v").alias("v"))
    most = max_sample + calibration
    bound = int(min(1.0, (most + 6 * most**0.5) / total) * (1 << 32))
    sample = [(r["id"], r["v"]) for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < bound).orderBy(F.xxhash64("id"), "id", "v").limit(most).toLocalIterator()]
    tree = Tree(np.array([v for _, v in sample[:max_sample]]), total, branching, leaf_size)
    ranks = calibration_ranks(rows, tree, list(dict(sample[max_sample:] or sample[:calibration]).items()), k)
    visits = int(np.quantile(ranks, target_recall, method="inverted_cdf")) + 1 if ranks else 1
    sent = spark.sparkContext.broadcast(tree)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, n = np.unique(sent.value.assign(_matrix(batch.column("v"))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    counts = np.zeros(tree.leaves, np.int64)
    for r in map_arrow(rows.select("v"), leaves_of, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    first, pieces, _ = _placement(counts, bucket_size)
    placed_schema = "bucket long, is_query boolean, id long, v array<double>, leaves array<long>"

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.assign(_matrix(batch.column("v")))
                nth = np.where(pieces[leaf] > 1, (mix(batch.column("id").to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64) % pieces[leaf], 0)
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32)), pa.array(leaf))
                yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + nth), pa.array(np.zeros(len(leaf), bool)), batch.column("id"), batch.column("v"), leaves], names=["bucket", "is_query", "id", "v", "leaves"])

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 100_000 // visits)
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                leaf = sent.value.visits(_matrix(part.column("v")), visits)
                row, leaf = np.repeat(np.arange(len(leaf)), leaf.shape[1]), leaf.ravel()
                n = pieces[leaf]
                bucket = np.repeat(first[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, leaf = np.repeat(row, n), np.repeat(leaf, n)
                order = np.lexsort((leaf, bucket, row))
                row, leaf, bucket = row[order], leaf[order], bucket[order]
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(head, len(leaf)).astype(np.int32)), pa.array(leaf))
                at = pa.array(row[head])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(np.ones(len(head), bool)), part.column("id").take(at), part.column("v").take(at), leaves], names=["bucket", "is_query", "id", "v", "leaves"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            bucket = group.column("bucket").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                whole = group.slice(a, b - a)
                held = whole.filter(pc.invert(whole.column("is_query"))).combine_chunks()
                wanted = whole.filter(whole.column("is_query"))
                if not len(held) or not len(wanted):
                    continue
                leaf = _flat(held.column("leaves"))
                known, where = np.unique(leaf, return_inverse=True)
                v, ids = _matrix(held.column("v").combine_chunks()), held.column("id").to_numpy()
                for begin in range(0, len(wanted), 512):
                    part = wanted.slice(begin, 512).combine_chunks()
                    own, visited = part.column("id").to_numpy(), part.column("leaves").combine_chunks()
                    of = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(visited)))
                    flat = visited.flatten().to_numpy()
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    hit = known[at] == flat  # a leaf may have no point
                    open_ = np.zeros((len(part), len(known)), bool)
                    open_[of[hit], at[hit]] = True
                    found = list(_nearest(v, ids, _matrix(part.column("v").combine_chunks()), own, k, open_[:, where]))
                    sizes = np.array([len(n) for _, n, _ in found])
                    near = pa.StructArray.from_arrays([pa.array(np.concatenate([d for _, _, d in found])), pa.array(np.concatenate([n for _, n, _ in found]))], ["d", "id"])
                    yield pa.RecordBatch.from_arrays([pa.array(own[[r for r, _, _ in found]]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), near)], names=["q", "near"])

    placed = map_arrow(rows, points, placed_schema).unionByName(map_arrow(asked, questions, placed_schema))
    best = map_arrow(placed.repartition("bucket").sortWithinPartitions("bucket"), compare, "q long, near array<struct<d: double, id: bigint>>")
    merged = best.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return asked.select(F.col("id").alias("q")).join(merged, "q", "left").select(F.col("q").alias(id_column), F.transform(F.coalesce("near", F.array().cast("array<struct<d: double, id: bigint>>")), lambda x: F.struct(x["id"].alias("id"), x["d"].alias("distance"))).alias("neighbours"))

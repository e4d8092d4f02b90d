"""Vectors as arrays of doubles: products, norms, codecs and exact neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits; what rounds to zero keeps its sign, as in SQL's round (Spark's gives 0.0 for it)."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def int8_codes(v: Column) -> Column:
    """struct(low, scale, codes): 256 steps between the least and the greatest element."""
    low, scale = F.array_min(v), (F.array_max(v) - F.array_min(v)) / 255
    code = lambda x: F.when(scale == 0, 0).otherwise(F.least(F.greatest(F.round((x - low) / scale), F.lit(0)), F.lit(255))).cast("int")
    return F.struct(low.alias("low"), scale.alias("scale"), F.transform(v, code).alias("codes"))


def int8_decode(codes: Column) -> Column:
    return F.transform(codes["codes"], lambda q: q * codes["scale"] + codes["low"])


def top_by_dot(vectors: DataFrame, query: DataFrame, k: int, id_column: str = "doc_id") -> DataFrame:
    """(id, score): the k vectors with the highest product with the one query vector (column q)."""
    scored = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(id_column, rounded(dot(F.col("v"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def centroid_weights(position: Column, n: Column) -> Column:
    """Weights of a document's chunks: the first and the last more, and the middle of long ones."""
    first = F.when((position == 0) & (n > 1), 1.5).otherwise(1.0)
    edge = F.when((position == n - 1) & (n > 2), 1.2).otherwise(first)
    tent = F.when(n > 4, 1 + 0.3 * (1 - 2 * F.abs(position / (n - 1) - 0.5))).otherwise(1.0)
    return edge * tent


def centroids(chunks: DataFrame, key: str, position: str) -> DataFrame:
    """(key, dim, value): weighted means of the vectors of each document."""
    w = Window.partitionBy(key)
    weighted = chunks.select(key, "v", (F.row_number().over(w.orderBy(position)) - 1).alias("p"), F.count("*").over(w).alias("n"))
    flat = weighted.select(key, centroid_weights(F.col("p"), F.col("n")).alias("w"), F.posexplode("v").alias("dim", "x"))
    return flat.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def doc_vectors(chunks: DataFrame, key: str, position: str) -> DataFrame:
    """(key, codes): the weighted mean vector of each document, of unit length, as int8 codes."""
    parts = centroids(chunks, key, position).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("p"))
    return parts.select(key, int8_codes(normalize(F.transform("p", lambda x: x["value"]))).alias("codes"))


def top_documents(docs: DataFrame, query: list[float], n: int = 100) -> DataFrame:
    """(path, score): the n documents whose vectors (codes) have the highest product with the query."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return docs.select("path", rounded(dot(int8_decode(F.col("codes")), q), 6).alias("score")).orderBy(F.desc("score"), "path").limit(n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / size)


@F.pandas_udf(T.BinaryType())
def float32_encode(v: pd.Series) -> pd.Series:
    """Little-endian single-precision bytes of a vector."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def float32_decode(b: pd.Series) -> pd.Series:
    """The vector of little-endian single-precision bytes; null where their number isn't a multiple of four."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def projection_matrix(rows: int, columns: int, seed: int = 7) -> np.ndarray:
    """Random normal entries of variance 2 / columns; the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((rows, columns)) * (2.0 / columns) ** 0.5


def save_projection(spark: SparkSession, folder: str, matrix: np.ndarray) -> None:
    """A matrix as one row of Parquet."""
    spark.createDataFrame([(matrix.shape[0], matrix.shape[1], matrix.ravel().tolist())], "n_rows int, n_columns int, entries array<double>").write.mode("overwrite").parquet(folder)


def load_projection(spark: SparkSession, folder: str) -> np.ndarray:
    row = spark.read.parquet(folder).first()
    return np.array(row["entries"]).reshape(row["n_rows"], row["n_columns"])


def project(v: Column, matrix: np.ndarray) -> Column:
    """Unit vectors after a random projection to as many dimensions as the matrix has rows, as int8 codes; null for another dimension than the matrix's."""

    @F.pandas_udf("low double, scale double, codes array<int>")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batch:
            if x is None or len(x) != matrix.shape[1]:
                rows.append((None, None, None))
                continue
            y = matrix @ np.asarray(x, float)
            size = np.linalg.norm(y)
            y = y / size if size else y
            low, scale = y.min(), (y.max() - y.min()) / 255
            codes = np.floor((y - low) / scale + 0.5) if scale else np.zeros(len(y))  # half away from zero
            rows.append((low, scale, np.clip(codes, 0, 255).astype(np.int32)))
        return pd.DataFrame(rows, columns=["low", "scale", "codes"])

    return run(v)


def capped_brute_force(vectors: DataFrame, query: DataFrame, k: int, cap: int = 20_000, id_column: str = "doc_id") -> DataFrame:
    """top_by_dot, if no more than `cap` vectors are to be compared: 0 is never, less than 0 always."""
    if cap == 0 or (cap > 0 and vectors.limit(cap + 1).count() > cap):
        return vectors.sparkSession.createDataFrame([], f"{id_column} long, score double")
    return top_by_dot(vectors, query, k, id_column)


def boundaries(chunks: DataFrame, key: str, order: str, length: Column, threshold: float) -> DataFrame:
    """(order, key, sim, position) where a chunk is unlike the one before it in its document; position counts the characters before it,
    one more for each chunk."""
    w = Window.partitionBy(key).orderBy(order)
    at = F.coalesce(F.sum(length + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("_before", F.lag("v").over(w)).withColumn("position", at).where("_before is not null")
    return rows.select(order, key, rounded(dot(F.col("v"), F.col("_before")), 6).alias("sim"), "position").where(F.col("sim") < threshold)


def max_sim(query: DataFrame, tokens: DataFrame, key: str, position: str | None = None, most: int = 128) -> DataFrame:
    """(key, score): the mean over query vectors (qid, q) of the best product with a document's vectors, at least 0."""
    kept = tokens
    if position is not None:  # a document keeps its first `most` vectors
        kept = tokens.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(position))).where(F.col("_nth") <= most)
    if query.count() > most:
        raise ValueError(f"a query has at most {most} vectors")
    each = kept.crossJoin(F.broadcast(query)).groupBy(key, "qid").agg(F.greatest(F.max(dot(F.col("v"), F.col("q"))), F.lit(0.0)).alias("best"))
    return each.groupBy(key).agg(rounded(F.avg("best"), 6).alias("score"))

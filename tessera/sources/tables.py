"""Tables of a data folder, and the corpus view that the retrieval operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the columns of the data model; one chunk a document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("source").alias("collection"),
        F.col("lang").alias("language"),
        F.lit("txt").alias("file_type"),
        "text",
        # seconds before NOW; documents are an hour apart from 2024-01-01 on
        (F.lit(60 * 86400) - F.col("doc_id") * 3600).alias("age"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, v, label): vectors are paired with documents by number only, for the mechanics."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at, length, content) of the files under root; hidden directories are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", r"^file:/*", "/")
    key = F.expr(f"substring(rel, {len(root.rstrip('/')) + 2})")
    return files.select(relative.alias("rel"), F.col("modificationTime").alias("modified_at"), "length", "content").withColumn("path", key).where(~F.col("path").rlike(r"(^|/)\.[^/]+/")).select("path", "modified_at", "length", "content")

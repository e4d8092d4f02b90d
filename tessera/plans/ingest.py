"""Ingest as one job: scan, compare with what is stored, read, chunk, embed what is new, and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import Splitter
from ..functions.code import MAX_INPUT, Registry
from ..functions.embedding import Embedder, embed_chunks
from ..functions.extract import extract_column
from ..functions.queries import extension
from ..sources.ignore import scan
from ..sources.store import Store, plan_embeddings


def changes(seen: DataFrame, known: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(path, action): index what is new or has another hash, keep the rest, delete what is gone; quarantined paths are skipped."""
    a = seen.join(quarantine.select("path"), "path", "left_anti").select("path", F.col("hash").alias("_new"))
    b = known.select("path", F.col("hash").alias("_old"))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "index").otherwise("keep")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def ingest(spark: SparkSession, root: str, store: Store, embed: Embedder, model: str, dims: int, splitter: Splitter = Splitter(), registry: Registry | None = None, include: list[str] = [], exclude: list[str] = [], collection: str = "") -> dict[str, int]:  # noqa: B006
    """Brings the store in step with the files under root, and counts what was done.

    Only new and changed files are read and chunked; only chunks whose content is in neither the document's chunks
    nor the cache are embedded. Files that can't be read are quarantined, those without text are deleted.
    """
    store.ensure_model(model, dims, True)
    files = scan(spark, root, include, exclude)
    todo = changes(files.select("path", "hash"), store.documents, store.quarantine).where("action <> 'keep'")
    read = files.join(todo.where("action = 'index'").select("path"), "path").withColumn("x", extract_column(F.col("path"), F.col("content"))).drop("content")
    known = store.documents.select("path", F.col("doc_id").alias("_id"))
    text = read.join(known, "path", "left").select(F.coalesce("_id", F.xxhash64("path")).alias("doc_id"), "path", "hash", "modified_at", F.col("x.text").alias("text"), F.col("x.error").alias("error"))
    store.write("reading", text)
    text = store.read("reading", "doc_id long, path string, hash string, modified_at timestamp, text string, error string")
    good = text.where("error is null and text <> ''")
    pieces = good.select("doc_id", F.posexplode((registry or Registry()).column(F.col("text"), F.col("path"), splitter, MAX_INPUT)).alias("chunk_index", "c"))
    new = pieces.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "c.heading", "c.content", F.sha2("c.content", 256).alias("content_hash"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("parent_id"))
    planned = plan_embeddings(new, store.chunks, store.cache)
    done = planned.where("origin <> 'embed'").unionByName(embed_chunks(planned.where("origin = 'embed'"), embed))
    store.write("embedded", done.drop("origin"))
    chunks = store.read("embedded", "chunk_id long, doc_id long, chunk_index int, heading string, content string, content_hash string, v array<double>, parent_id long")
    docs = good.select("doc_id", "path", "hash", "modified_at", extension(F.col("path")).alias("file_type"), F.lit("").alias("language"), F.col("path").alias("title"), F.lit(None).cast("map<string,string>").alias("tags"), F.lit(collection).alias("collection"))
    counts = {"indexed": docs.count(), "chunks": chunks.count()}
    failed = text.where("error is not null").select("path", "error", F.current_timestamp().alias("created_at"))
    gone = todo.where("action = 'delete'").select("path")
    deleted = gone.count()
    empty = text.where("error is null and (text is null or text = '')").select("path")
    names = gone.unionByName(empty).unionByName(failed.select("path"))
    store.write("going", names.distinct())
    going = store.read("going", "path string")
    store.reindex(docs, chunks)
    store.write("documents", store.documents.join(going, "path", "left_anti"))
    store.write("chunks", store.chunks.join(store.documents.select("doc_id"), "doc_id", "left_semi").select(*chunks.columns))
    store.remember(chunks)
    store.fail(failed)
    return counts | {"deleted": deleted, "failed": failed.count()}

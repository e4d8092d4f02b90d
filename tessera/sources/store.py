"""Documents, chunks and side tables in Parquet, and the changes to them.

Changes are plain functions of DataFrames; `Store` keeps their results as numbered versions of its tables, so that readers of the
last version aren't disturbed and a lost executor can read again what it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENTS = "doc_id long, path string, hash string, modified_at timestamp, file_type string, language string, title string, tags map<string, string>, collection string"
CHUNKS = "chunk_id long, doc_id long, chunk_index int, heading string, content string, content_hash string, v array<double>, parent_id long"
QUARANTINE = "path string, error string, attempts int, created_at timestamp"
CACHE = "content_hash string, v array<double>"
METADATA = "model string, dims int, normalized boolean"


def upsert(old: DataFrame, new: DataFrame, key: str = "path", keep: str = "doc_id") -> DataFrame:
    """old with the rows of new; a row of new with a known key takes its place and its `keep`."""
    ids = old.select(key, F.col(keep).alias("_old"))
    named = new.join(ids, key, "left").withColumn(keep, F.coalesce("_old", keep)).drop("_old")
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(named.select(*old.columns))


def replace_rows(rows: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows without those of the keys in new, and new: chunks of documents that were indexed again."""
    return rows.join(new.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def below(path: Column, prefix: str) -> Column:
    """The path or a path below it; all for '' and '.'."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")


def without_orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def chunks_by_hash(chunks: DataFrame, doc_id: int) -> DataFrame:
    """(content_hash, chunk_id, v) of a document; of chunks with the same content the last one."""
    last = F.max_by(F.struct("chunk_id", "v"), F.struct("chunk_index", "chunk_id")).alias("l")
    return chunks.where(F.col("doc_id") == doc_id).groupBy("content_hash").agg(last).select("content_hash", "l.chunk_id", "l.v")


def chunk_by_id(chunks: DataFrame, documents: DataFrame, chunk_id: int) -> DataFrame:
    """A chunk with its document's path."""
    return chunks.where(F.col("chunk_id") == chunk_id).join(documents.select("doc_id", "path"), "doc_id")


def plan_embeddings(new: DataFrame, stored: DataFrame, cache: DataFrame) -> DataFrame:
    """new chunks with v and `origin`: stored (the document has the content), cached (another has had it) or embed (v is null)."""
    a = stored.groupBy("doc_id", "content_hash").agg(F.first("v", ignorenulls=True).alias("_own"))
    b = cache.groupBy("content_hash").agg(F.first("v", ignorenulls=True).alias("_any"))
    both = new.drop("v").join(a, ["doc_id", "content_hash"], "left").join(b, "content_hash", "left")
    return both.withColumn("v", F.coalesce("_own", "_any")).withColumn("origin", F.when(F.col("_own").isNotNull(), "stored").when(F.col("_any").isNotNull(), "cached").otherwise("embed")).drop("_own", "_any")


def quarantined(old: DataFrame, failures: DataFrame) -> DataFrame:
    """The quarantine after failures (path, error, created_at): a path that is there has one attempt more for each failure and its last error."""
    new = failures.groupBy("path").agg(F.max_by("error", F.struct("created_at", "error")).alias("error"), F.count("*").cast("int").alias("attempts"), F.max("created_at").alias("created_at"))
    both = old.unionByName(new)
    return both.groupBy("path").agg(F.max_by("error", F.struct("created_at", "error")).alias("error"), F.sum("attempts").cast("int").alias("attempts"), F.max("created_at").alias("created_at"))


def metadata_change(current: dict | None, wanted: dict, rows: int) -> tuple[bool, bool]:
    """(whether the index must be emptied, whether the metadata must be written)."""
    if current is None:
        return rows > 0, True
    return current != wanted, current != wanted


@dataclass(frozen=True)
class Store:
    """Tables under a folder; each write makes a new version of a table."""

    spark: SparkSession
    folder: str

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str, schema: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromDDL(schema)).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame, files: int = 0) -> None:
        """A new version; with `files` the rows are packed into as many (compaction)."""
        (rows.repartition(files) if files else rows).write.parquet(f"{self.folder}/{name}/v{max(self._versions(name), default=0) + 1}")

    def vacuum(self, name: str) -> None:
        """Old versions go."""
        jvm = self.spark._jvm
        for v in self._versions(name)[:-1]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v{v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @property
    def documents(self) -> DataFrame:
        return self.read("documents", DOCUMENTS)

    @property
    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNKS)

    @property
    def quarantine(self) -> DataFrame:
        return self.read("quarantine", QUARANTINE)

    @property
    def cache(self) -> DataFrame:
        return self.read("cache", CACHE)

    def reindex(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Documents that are new or have changed, with all their chunks (doc_id as in `documents`)."""
        known = self.documents.select("path", F.col("doc_id").alias("_old"))
        ids = documents.select("path", "doc_id").join(known, "path", "left").select("doc_id", F.coalesce("_old", "doc_id").alias("_id"))
        placed = chunks.join(ids, "doc_id").drop("doc_id").withColumnRenamed("_id", "doc_id").select(*StructType.fromDDL(CHUNKS).names)
        gone = ids.select(F.col("_id").alias("doc_id"))
        kept = self.chunks.join(gone, "doc_id", "left_anti").select(*placed.columns)
        self.write("chunks", kept.unionByName(placed))
        self.write("documents", upsert(self.documents, documents))

    def delete(self, condition: Column) -> None:
        """Documents that fit the condition, and their chunks."""
        left = self.documents.where(~F.coalesce(condition, F.lit(False)))
        self.write("documents", left)
        self.write("chunks", without_orphans(self.chunks, self.documents))

    def rename(self, old: str, new: str) -> None:
        self.write("documents", self.documents.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path"))))

    def fail(self, failures: DataFrame) -> None:
        self.write("quarantine", quarantined(self.quarantine, failures))

    def release(self, condition: Column | None = None) -> None:
        """Paths leave the quarantine: those that fit the condition, or all."""
        self.write("quarantine", self.quarantine.where(~condition) if condition is not None else self.quarantine.limit(0))

    def remember(self, chunks: DataFrame) -> None:
        """Vectors by content, for other documents with the same content."""
        new = chunks.where("v is not null").groupBy("content_hash").agg(F.first("v").alias("v"))
        self.write("cache", replace_rows(self.cache, new, "content_hash"))

    def ensure_model(self, model: str, dims: int, normalized: bool) -> bool:
        """Whether the index was emptied because it was made with another model."""
        row = self.read("metadata", METADATA).first()
        wanted = {"model": model, "dims": dims, "normalized": normalized}
        held = 0 if row else self.documents.limit(1).count() + self.chunks.limit(1).count()
        empty, write = metadata_change(row.asDict() if row else None, wanted, held)
        if empty:
            for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS)):
                self.write(name, self.spark.createDataFrame([], schema))
        if write:
            self.write("metadata", self.spark.createDataFrame([tuple(wanted.values())], METADATA))
        return empty

"""The eight operations of the engine over documents, vectors and their index, with the rules of their arguments."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.embedding import QueryCache
from .operators import vector
from .operators.filters import SearchFilter
from .operators.index import Index
from .operators.rerank import spread_over_paths
from .operators.search import Reranker, SearchOptions, hybrid_search
from .sources.ignore import search_prefix

MAX_QUERY = 4000
SNIPPET, OUTPUT, EXCERPT = 1200, 12_000, 200


def bounded(value: float | None, default: int, most: int) -> int:
    """A limit: the default where it is no number of at least 1, and at most `most`."""
    if value is None or math.isnan(value) or math.isinf(value) or value < 1:
        return default
    return min(int(value), most)


def chunk_number(value: float) -> int:
    if math.isnan(value) or math.isinf(value) or value <= 0:
        raise ValueError("chunk_id must be a positive number")
    return int(value)


def query_text(query: str) -> str:
    """A query without white space around it, and at most MAX_QUERY characters long."""
    if not query or not query.strip():
        raise ValueError("a query is required")
    return query.strip()[:MAX_QUERY]


def within_budget(results: DataFrame, order: str, header: int = 0, snippet: int = SNIPPET, total: int = OUTPUT) -> DataFrame:
    """Results with a snippet of their text, as long as snippets and headers fit in `total` characters; the first is cut to fit."""
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    rows = results.withColumn("snippet", F.substring(text, 1, min(snippet, max(0, total - header))))
    used = F.sum(F.length("snippet") + header).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= total).drop("used")


@dataclass(frozen=True)
class Engine:
    """docs: doc_id, path, collection, language, file_type, text, age; vectors: doc_id, v. embed: the cache of query embeddings, or
    None for keyword search only."""

    docs: DataFrame
    vectors: DataFrame
    index: Index
    embed: QueryCache | None = None
    root: str = "/"
    reranker: Reranker | None = None

    def _vector(self, query: str) -> list[float] | None:
        if self.embed is None:
            return None
        try:
            return self.embed.get(query)
        except Exception:  # noqa: BLE001 - without its vector a query is searched by keywords
            return None

    def search(self, query: str, limit: float | None = None, threshold: float = 0.0, path: str = "", file_type: str = "", language: str = "", collection: str = "") -> DataFrame:
        """(doc_id, path, score), the best first; lists of file types and languages are separated by commas."""
        query = query_text(query)
        many = lambda x: tuple(y.strip() for y in x.split(",") if y.strip())
        where = SearchFilter(many(file_type), many(language), {}, collection, search_prefix(self.root, path))
        return hybrid_search(self.docs, self.vectors, self.index, query, self._vector(query), SearchOptions(bounded(limit, 5, 50), threshold), where, self.reranker)

    def list_sources(self, limit: float | None = None) -> tuple[int, int, DataFrame]:
        """(documents, rows shown, rows by path)."""
        total, most = self.docs.count(), bounded(limit, 100, 500)
        return total, min(total, most), self.docs.orderBy("path").limit(most).select("doc_id", "path", "collection")

    def index_status(self) -> DataFrame:
        """One row: documents, vectors, the index's figures, and the state: ready, or degraded where the index lags behind."""
        d = self.docs.agg(F.count("*").alias("docs"))
        v = self.vectors.agg(F.count("*").alias("vectors"))
        rows = d.crossJoin(v).crossJoin(self.index.diagnostics(self.docs.sparkSession))
        return rows.withColumn("state", F.when((F.col("docs") == F.col("n_docs")) & F.col("in_step"), "ready").otherwise("degraded"))

    def find_similar(self, chunk_id: float, limit: float | None = None) -> DataFrame:
        """(doc_id, path, score): the nearest others of a chunk; none where it has no vector."""
        seed = chunk_number(chunk_id)
        near = vector.top_by_dot(self.vectors.where(F.col("doc_id") != seed), self.vectors.where(F.col("doc_id") == seed).select(F.col("v").alias("q")), bounded(limit, 5, 50))
        return self.docs.select("doc_id", "path").join(F.broadcast(near), "doc_id").orderBy(F.desc("score"), "doc_id")  # at most 50 rows

    def list_collections(self) -> DataFrame:
        """(collection, docs), without the nameless one."""
        return self.docs.where("collection <> ''").groupBy("collection").agg(F.countDistinct("doc_id").alias("docs")).orderBy("collection")

    def delete_collection(self, collection: str) -> tuple[int, Engine]:
        """(documents deleted, the engine without them); the index is brought up to date by Index.sync."""
        if not collection:
            raise ValueError("a collection is required")
        left = self.docs.where(~F.coalesce(F.col("collection") == collection, F.lit(False)))
        gone = self.docs.where(F.col("collection") == collection).select("doc_id")
        return gone.count(), replace(self, docs=left, vectors=self.vectors.join(gone, "doc_id", "left_anti"), index=self.index.sync(left, gone))

    def drill_down(self, chunk_id: float, limit: float | None = None) -> DataFrame:
        """(position, doc_id, path, score): chunks near a chunk, from documents not seen before as far as there are."""
        seed, most = chunk_number(chunk_id), bounded(limit, 10, 50)
        row = self.docs.where(F.col("doc_id") == seed).select("path").first()
        if row is None:
            raise ValueError(f"chunk {seed} not found")
        return spread_over_paths(self.find_similar(seed, most), F.lit(row["path"]), most)

    def summarize_matches(self, query: str, limit: float | None = None) -> DataFrame:
        """(position, path, excerpt): the documents of the best matches in order, and excerpts of the first five matches."""
        found = self.docs.select("doc_id", "text").join(F.broadcast(self.search(query, bounded(limit, 20, 50))), "doc_id")
        return match_summary(found)


def match_summary(found: DataFrame) -> DataFrame:
    """(position, path, excerpt) of results (doc_id, path, score, text): each path once, at its best match."""
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id")  # at most 50 rows
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    cut = F.when(F.length(text) > EXCERPT, F.concat(F.substring(text, 1, EXCERPT), F.lit("..."))).otherwise(text)
    rows = found.withColumn("r", F.row_number().over(whole)).select("r", "path", F.when(F.col("r") <= 5, cut).alias("excerpt"))
    first = rows.groupBy("path").agg(F.min("r").alias("r"), F.min_by("excerpt", "r").alias("excerpt"))
    return first.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r")).alias("position"), "path", "excerpt")



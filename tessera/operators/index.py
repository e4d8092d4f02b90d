"""The inverted index: postings, sorted by term, in Parquet.

A row has a document's term with its frequency, its positions and the document's length, so that a search reads nothing but the
rows of its terms. The postings are made in blocks of documents with BLOCK bytes of text, each sorted by term where it is made: nothing is
shuffled, and a block is all that a task holds. A file has the blocks of a task. Parquet's statistics of row groups and pages prune
all that holds none of a query's terms, prefixes included; a block has each term once, in few pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import TOKEN, fold, porter
from ..sources.workspace import shared_folder

#: Bytes of text that are inverted at once, and postings that are handed over at once.
BLOCK, POSTED = 32 << 20, 50_000
POSTINGS = "doc_id long, term string, tf int, dl int, positions array<int>"


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens before folding and stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows (doc_id, words) in tables of about `most` bytes of words; a longer text is in a table of its own."""
    held, size = [], 0
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        begin = 0
        while begin < batch.num_rows:
            done = end[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(end, done + most - size, side="right")))
            held.append(batch.slice(begin, stop - begin))
            size += end[stop - 1] - done
            begin = stop
            if size >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _inverted(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of a block, sorted by term."""
    lists = pc.split_pattern(block.column("words").combine_chunks(), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return
    stems = pa.array([porter(fold(w)) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    order = pc.sort_indices(stems.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    names = stems.dictionary.take(pa.array(order))
    term = rank[stems.indices.to_numpy()][words.indices.to_numpy()]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    position = (np.arange(len(term)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes) + 1).astype(np.int32)
    by_term = np.argsort(term, kind="stable")  # documents and positions are in order
    term, owner, position = term[by_term], owner[by_term], position[by_term]
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]))
    ends, doc_id = np.append(head, len(term)), block.column("doc_id").combine_chunks()
    for begin in range(0, len(head), POSTED):
        cut = ends[begin : begin + POSTED + 1]
        at = owner[cut[:-1]]
        lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(position[cut[0] : cut[-1]]))
        yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(at)), names.take(pa.array(term[cut[:-1]])), pa.array(np.diff(cut).astype(np.int32)), pa.array(sizes[at]), lists], names=["doc_id", "term", "tf", "dl", "positions"])


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl, positions) of every term of every document, block by block in order of terms; positions count from 1.

    Null and empty texts have no postings; rows that share a doc_id are posted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            yield from _inverted(block)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = docs.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < least:  # a table of fewer splits than cores: it is small, and its texts may move
        texts = texts.repartition(least)
    # the tokens with blanks between them: one string a text costs less to hand over than many
    words = F.trim(F.regexp_replace(F.lower("text"), f"[^{TOKEN.strip('[]+')}]+", " "))
    rows = texts.select("doc_id", words.alias("words")).where("words <> ''")
    return rows.mapInArrow(run, POSTINGS)


@dataclass(frozen=True)
class Index:
    """Stored postings, with the number of documents and their mean length."""

    folder: str
    n_docs: int
    avgdl: float

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> Index:
        """Writes the postings of docs under folder, over any that are there."""
        postings(docs).write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
        spark = docs.sparkSession
        total = spark.read.parquet(f"{folder}/postings").agg(F.sum("tf").alias("n")).first()["n"] or 0
        n_docs = docs.count()
        spark.createDataFrame([(n_docs, total)], "n_docs long, n_tokens long").write.mode("overwrite").parquet(f"{folder}/statistics")
        return cls(folder, n_docs, total / n_docs if n_docs else 0.0)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        row = spark.read.parquet(f"{folder}/statistics").first()
        return cls(folder, row["n_docs"], row["n_tokens"] / row["n_docs"] if row["n_docs"] else 0.0)

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")

    def sync(self, docs: DataFrame, changed: DataFrame) -> Index:
        """The index after the documents in `changed` (doc_id) were written, deleted or added: only their postings are made anew."""
        spark = docs.sparkSession
        ids = changed.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        new = postings(docs.join(ids, "doc_id", "left_semi"))
        rows = self.postings(spark).join(ids, "doc_id", "left_anti").unionByName(new)
        folder = f"{self.folder}-next"
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        total = spark.read.parquet(f"{folder}/postings").agg(F.sum("tf").alias("n")).first()["n"] or 0
        n_docs = docs.count()
        spark.createDataFrame([(n_docs, total)], "n_docs long, n_tokens long").write.mode("overwrite").parquet(f"{folder}/statistics")
        return Index(folder, n_docs, total / n_docs if n_docs else 0.0)

    def stale(self, modified: int, share: float = 0.2) -> bool:
        """Whether so many documents have changed that the index is better built anew than synchronised."""
        return self.n_docs > 0 and modified / self.n_docs > share

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        """One row: documents indexed, those with a posting, postings, and whether the two agree with the statistics."""
        p = self.postings(spark).agg(F.countDistinct("doc_id").alias("with_terms"), F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
        return p.select(F.lit(self.n_docs).cast("long").alias("n_docs"), "with_terms", "postings", "n_tokens", (F.round(F.col("n_tokens") / max(1, self.n_docs), 6) == round(self.avgdl, 6)).alias("in_step"))


_OPEN: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, name: str, docs: DataFrame) -> Index:
    """The index of a data folder, built once a session."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _OPEN:
        _OPEN[key] = Index.build(docs, f"{shared_folder(spark)}/index/{key[0]}/{name.strip('/').replace('/', '_')}")
    return _OPEN[key]

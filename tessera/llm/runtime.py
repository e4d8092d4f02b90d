"""Spark plumbing shared by the corpus operators: checkpoints, Arrow batches, sorted groups."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder of spark.checkpoint.dir and read back.

    The folder comes from the session; only where it is unset on a single machine (master local: tests) a temporary
    folder is set. On a cluster without it there is no folder that executors share: that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text; a longer text is in a slice of its own.

    Whole texts are kept: only the number of rows that are handled at once is bounded.
    """
    if not batch.num_rows:
        return
    place = [x.lower() for x in batch.schema.names].index(column)  # names are compared as Spark does
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `key` (not null); a group is never divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        first_of_last = pc.index(pc.equal(keys, last), True).as_py()
        if first_of_last or (held and held[-1].column(key)[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, first_of_last)], schema=batch.schema)
            held = []
        held.append(batch.slice(first_of_last))
    if held:
        yield pa.Table.from_batches(held)


def _release() -> None:
    """Give freed memory back to the system, so that an idle Python worker doesn't hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow; a worker that is done with a partition releases its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _release()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]], limit: int = 4_000_000) -> DataFrame:
    """The rows of docs for which `keep` says so, in one pass without a shuffle; columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=limit):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def replace_text(docs: DataFrame, change: Callable[[list], list], limit: int = 4_000_000) -> DataFrame:
    """The rows of docs with their texts changed, in one pass without a shuffle."""
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=limit):
                column = part.column(place)
                yield part.set_column(place, part.schema.field(place), pa.array(change(column.to_pylist()), column.type))

    return map_arrow(docs, run, docs.schema)

"""The queries of the engine by name, the DuckDB SQL of those that SQL can express, and common tables of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

D = "d AS (SELECT doc_id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, source AS collection, lang AS language, text, 60 * 86400 - doc_id * 3600 AS age FROM documents)"
V = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def query(sql: str | None = None) -> Callable:
    """Registers a query, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    """A SELECT of literal rows: what a query over a fixture must give."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]" + ("" if x else "::VARCHAR[]")
        return "E'" + str(x).replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"

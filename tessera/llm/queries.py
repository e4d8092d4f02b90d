"""The corpus operators as queries over the Parquet tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .decontaminate import contamination
from .html import extract_pages
from .jaccard import jaccard_classes
from .langid import identify_language
from .lm_score import score_documents
from .packing import pack
from .pii import surrogates
from .runtime import table
from .toxicity import score_toxicity
from .warc import reassemble, to_records


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, by Jaccard similarities of word 3-grams of at least 0.5."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest verbatim matches of the benchmark in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return surrogates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify_language(table(spark, sf_dir, "documents"))


def op6_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as segmented WARC records with chunked bodies and put together again."""
    done = reassemble(to_records(table(spark, sf_dir, "pages")))
    return done.select(F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+):", 1).try_cast("long").alias("page_id"), "url", "status", "n_bytes", F.decode("body", "UTF-8").alias("html"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words for all documents."""
    return pack(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours, among all embeddings, of those whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, queries=vectors.where("vec_id % 50 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from its nearest labelled examples."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_html_extraction, op4_pii_surrogates, op5_language_id, op6_warc_reassembly, op7_lm_scoring, op8_best_fit_packing, op9_nearest_neighbours, op10_toxicity)}

ORACLES = {
    "op6_warc_reassembly": "SELECT page_id, url, CASE WHEN html IS NULL THEN 'no_payload' ELSE 'ok' END AS status, strlen(html) AS n_bytes, html FROM pages",
}

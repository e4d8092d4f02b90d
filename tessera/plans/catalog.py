"""All queries of the engine over the Parquet tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import within_budget
from ..operators import ranking, vector
from ..operators.filters import SearchFilter
from ..sources.store import below, chunks_by_hash, chunk_by_id, replace_rows, upsert
from ..sources.tables import corpus, table, vectors
from ..streaming import live
from .registry import ORACLES, QUERIES, D, V, query

from . import catalog_search, catalog_state, catalog_text  # noqa: F401, E402 - they register their queries

__all__ = ["ORACLES", "QUERIES"]

# --- sources, filters, catalog ---


@query(f"WITH {D} SELECT doc_id, path, collection FROM d ORDER BY path LIMIT 100")
def list_sources(spark, sf):
    """The first 100 documents by path."""
    return corpus(spark, sf).orderBy("path").limit(100).select("doc_id", "path", "collection")


@query(f"WITH {D} SELECT doc_id, path, language FROM d WHERE path = (SELECT path FROM d WHERE doc_id = 7)")
def point_lookup(spark, sf):
    """The document of a path."""
    path = corpus(spark, sf).where("doc_id = 7").select("path").first()["path"]
    return corpus(spark, sf).where(F.col("path") == path).select("doc_id", "path", "language")


@query("SELECT doc_id AS chunk_id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, text AS content FROM documents WHERE doc_id = 12")
def chunk_lookup(spark, sf):
    """A chunk with its document, by number."""
    c = corpus(spark, sf)
    chunks = c.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"))
    return chunk_by_id(chunks, c, 12).select("chunk_id", "path", "content")


@query("SELECT sha256(lang) AS content_hash, max(doc_id) AS chunk_id FROM documents WHERE source = 'src3' GROUP BY 1")
def document_chunks_by_hash(spark, sf):
    """Chunks of one document by content hash, the last one of equal ones: a collection stands for the document, languages for contents."""
    c = corpus(spark, sf).where("collection = 'src3'").select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), F.sha2("language", 256).alias("content_hash"), F.lit(0).alias("v"))
    return chunks_by_hash(c, 1).select("content_hash", "chunk_id")


@query(f"WITH {D} SELECT doc_id, path FROM d WHERE 'txt' IN ('txt', 'md') AND length(path) % 2 = 0")
def file_type_filter(spark, sf):
    kept = corpus(spark, sf).where(SearchFilter(file_types=("txt", "md")).predicate())
    return kept.where(F.length("path") % 2 == 0).select("doc_id", "path")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src2'")
def tag_filter(spark, sf):
    """Documents by a tag; the language is their tag."""
    c = corpus(spark, sf).withColumn("tags", F.create_map(F.lit("lang"), F.col("language")))
    return c.where(SearchFilter(tags={"lang": "fr"}, collection="src2").predicate()).select("doc_id")


@query(f"WITH {D} SELECT collection, count(DISTINCT doc_id) AS docs, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM d WHERE collection <> '' GROUP BY collection")
def collection_stats(spark, sf):
    """Documents and chunks of each collection, in one aggregation."""
    return corpus(spark, sf).where("collection <> ''").groupBy("collection").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("SELECT DISTINCT source AS collection FROM documents WHERE source <> ''")
def list_collections(spark, sf):
    return corpus(spark, sf).where("collection <> ''").select("collection").distinct()


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS empty_docs")
def index_stats(spark, sf):
    """Sizes of the index."""
    d = corpus(spark, sf).agg(F.count("*").alias("docs"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty_docs"))
    return d.crossJoin(vectors(spark, sf).agg(F.count("*").alias("vectors"))).select("docs", "vectors", "empty_docs")


@query(f"WITH {D} SELECT doc_id, path FROM d WHERE language IN ('en', 'de') AND collection = 'src1'")
def metadata_filter(spark, sf):
    return corpus(spark, sf).where(SearchFilter(languages=("en", "de"), collection="src1").predicate()).select("doc_id", "path")


@query(f"WITH {D} SELECT doc_id, path FROM d WHERE starts_with(lower(path), 'src2/fr/')")
def path_prefix_filter(spark, sf):
    return corpus(spark, sf).where(SearchFilter(path_prefix="SRC2/fr/").predicate()).select("doc_id", "path")


@query(f"WITH {D} SELECT doc_id, path FROM d WHERE NOT starts_with(path, 'src0/')")
def delete_prefix(spark, sf):
    """What is left after a directory is deleted."""
    return corpus(spark, sf).where(~below(F.col("path"), "src0")).select("doc_id", "path")


@query("SELECT collection, count(*) AS n FROM (SELECT source AS collection FROM documents WHERE source NOT IN ('src0', 'src5')) GROUP BY collection")
def delete_collection(spark, sf):
    """Documents by collection after two collections are deleted."""
    gone = spark.createDataFrame([("src0",), ("src5",)], "collection string")
    return corpus(spark, sf).join(F.broadcast(gone), "collection", "left_anti").groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf):
    """One document for each content."""
    return corpus(spark, sf).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1), o AS (SELECT sha256(text) AS h, min(doc_id) AS old_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, old_id, CASE WHEN old_id IS NULL THEN 'embed' ELSE 'reuse' END AS action FROM n LEFT JOIN o USING (h)")
def chunk_diff(spark, sf):
    """New chunks against stored ones by content hash: only the others are embedded."""
    c = corpus(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    old = c.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("old_id"))
    return c.where("doc_id % 2 = 1").join(old, "h", "left").select("doc_id", "old_id", F.when(F.col("old_id").isNull(), "embed").otherwise("reuse").alias("action"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'index' WHEN d.doc_id IS NULL THEN 'delete' ELSE 'sync' END AS action FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id AND l.doc_id % 3 <> 0")
def reconcile(spark, sf):
    """What the scan found against what is indexed."""
    seen = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("seen"))
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("known_id"))
    both = seen.join(known, (F.col("doc_id") == F.col("known_id")) & (F.col("known_id") % 3 != 0), "full")
    return both.select(F.coalesce("doc_id", "known_id").alias("doc_id"), F.when(F.col("known_id").isNull(), "index").when(F.col("doc_id").isNull(), "delete").otherwise("sync").alias("action"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def orphans_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("WITH r AS (SELECT doc_id, source, lang FROM documents), s AS (SELECT doc_id, source, 'xx' AS lang FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id + 1000000000, source, lang FROM documents WHERE doc_id % 7 = 0) SELECT coalesce(s.doc_id, r.doc_id) AS doc_id, coalesce(s.source, r.source) AS source, coalesce(s.lang, r.lang) AS lang FROM r FULL JOIN s USING (doc_id)")
def document_upsert(spark, sf):
    """New rows replace those with their key."""
    old = table(spark, sf, "documents").select("doc_id", "source", "lang")
    new = old.where("doc_id % 5 = 0").withColumn("lang", F.lit("xx")).unionByName(old.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000))
    return replace_rows(old, new)


@query(f"WITH {D}, n AS (SELECT path || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.new' END AS path, doc_id + 500000000 AS doc_id, 'xx' AS language FROM d WHERE doc_id % 2 = 0) SELECT path, coalesce(d.doc_id, n.doc_id) AS doc_id, coalesce(n.language, d.language) AS language FROM d FULL JOIN n USING (path)")
def upsert_by_path(spark, sf):
    """New documents with a known path keep that path's id."""
    c = corpus(spark, sf).select("path", "doc_id", "language")
    new = c.where("doc_id % 2 = 0").select(F.concat("path", F.when(F.col("doc_id") % 3 == 0, "").otherwise(".new")).alias("path"), (F.col("doc_id") + 500000000).alias("doc_id"), F.lit("xx").alias("language"))
    return upsert(c, new)


@query("SELECT doc_id, 0 AS part, text FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, unnest([1, 2]) AS part, 'new' AS text FROM documents WHERE doc_id % 4 = 0")
def reindex_documents(spark, sf):
    """Chunks after a quarter of the documents were indexed again, in two chunks each."""
    old = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("part"), "text")
    new = old.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), F.lit("new").alias("text"))
    return replace_rows(old, new)


@query(f"WITH {D} SELECT doc_id, CASE WHEN starts_with(path, 'src1/') THEN 'archive/' || substr(path, 6) ELSE path END AS path FROM d")
def rename_path(spark, sf):
    c = corpus(spark, sf)
    return c.select("doc_id", F.when(F.col("path").startswith("src1/"), F.concat(F.lit("archive/"), F.expr("substring(path, 6)"))).otherwise(F.col("path")).alias("path"))


@query("SELECT doc_id, trim(substr(text, 1, 200)) AS excerpt, length(text) AS n FROM documents")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.trim(F.substring("text", 1, 200)).alias("excerpt"), F.length("text").alias("n"))


@query(r"WITH r AS (SELECT doc_id, substr(trim(text, E' \t\n\r\f'), 1, 1200) AS snippet FROM documents ORDER BY doc_id LIMIT 50) SELECT doc_id, length(snippet) AS n FROM (SELECT *, sum(length(snippet) + 100) OVER (ORDER BY doc_id) AS used FROM r) WHERE used <= 12000")
def output_budget(spark, sf):
    """The first of 50 results whose snippets, with headers of 100 characters, fit in 12000 characters together."""
    top = table(spark, sf, "documents").orderBy("doc_id").limit(50)
    return within_budget(top, "doc_id", 100).select("doc_id", F.length("snippet").alias("n"))


# --- vectors ---

_Q = "q AS (SELECT v AS q FROM v WHERE doc_id = 7)"


def _query_vector(spark, sf):
    return vectors(spark, sf).where("doc_id = 7").select(F.col("v").alias("q"))


@query(f"WITH {V}, {_Q} SELECT doc_id, round(list_inner_product(v, q), 6) AS score FROM v, q ORDER BY score DESC, doc_id LIMIT 10")
def knn_topk(spark, sf):
    return vector.top_by_dot(vectors(spark, sf), _query_vector(spark, sf), 10)


@query(f"WITH {V}, {_Q} SELECT doc_id, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE doc_id <> 7 ORDER BY score DESC, doc_id LIMIT 5")
def find_similar(spark, sf):
    """Neighbours of a seed chunk, without it."""
    return vector.top_by_dot(vectors(spark, sf).where("doc_id <> 7"), _query_vector(spark, sf), 5)


@query(f"WITH {V}, {_Q} SELECT doc_id, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE label IN (SELECT label FROM v GROUP BY label HAVING label % 2 = 0) ORDER BY score DESC, doc_id LIMIT 10")
def knn_filtered(spark, sf):
    """Neighbours among the vectors of some labels."""
    v = vectors(spark, sf)
    labels = v.where("label % 2 = 0").select("label").distinct()
    return vector.top_by_dot(v.join(labels, "label", "left_semi"), _query_vector(spark, sf), 10)


@query(f"WITH {V} SELECT doc_id, [round(x / sqrt(list_sum([y * y FOR y IN v])), 6) FOR x IN v] AS unit FROM v")
def normalize_vectors(spark, sf):
    return vectors(spark, sf).select("doc_id", F.transform(vector.normalize(F.col("v")), lambda x: vector.rounded(x, 6)).alias("unit"))


@query(f"WITH {V}, c AS (SELECT doc_id, v, list_min(v) AS low, (list_max(v) - list_min(v)) / 255 AS scale FROM v) SELECT doc_id, round(scale, 9) AS scale, list_max([abs(x - (round((x - low) / scale) * scale + low)) FOR x IN v]) <= scale / 2 + 1e-12 AS within FROM c")
def int8_roundtrip_error(spark, sf):
    c = vectors(spark, sf).select("doc_id", "v", vector.int8_codes(F.col("v")).alias("c"))
    worst = F.array_max(F.zip_with("v", vector.int8_decode(F.col("c")), lambda x, y: F.abs(x - y)))
    return c.select("doc_id", F.round("c.scale", 9).alias("scale"), (worst <= F.col("c.scale") / 2 + 1e-12).alias("within"))


@query(f"WITH {V}, p AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM v), w AS (SELECT label, v, CASE WHEN p = n - 1 AND n > 2 THEN 1.2::DOUBLE WHEN p = 0 AND n > 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n > 4 THEN 1 + 0.3::DOUBLE * (1 - 2 * abs(p / (n - 1) - 0.5)) ELSE 1 END AS w FROM p), f AS (SELECT label, w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM w) SELECT label, dim::INT AS dim, round(sum(x * w) / sum(w), 6) AS value FROM f GROUP BY ALL")
def doc_centroids(spark, sf):
    """Weighted mean vectors, with labels for documents."""
    return vector.centroids(vectors(spark, sf), "label", "doc_id").select("label", "dim", vector.rounded(F.col("value"), 6).alias("value"))


@query(f"WITH {V}, q AS (SELECT doc_id AS qid, v AS q FROM v WHERE doc_id < 4), s AS (SELECT label, qid, greatest(max(list_inner_product(v, q)), 0) AS best FROM v, q GROUP BY ALL) SELECT label, round(avg(best), 6) AS score FROM s GROUP BY label ORDER BY score DESC, label LIMIT 5")
def maxsim_topk(spark, sf):
    """Late interaction: the query's vectors against those of each label."""
    v = vectors(spark, sf)
    q = v.where("doc_id < 4").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    return vector.max_sim(q, v, "label").orderBy(F.desc("score"), "label").limit(5)


@query(f"WITH {V}, s AS (SELECT doc_id, label, round(list_inner_product(v, lag(v) OVER w), 6) AS sim, coalesce(sum(doc_id % 50 + 1) OVER (PARTITION BY label ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM v WINDOW w AS (PARTITION BY label ORDER BY doc_id)) SELECT doc_id, label, sim, position FROM s WHERE sim < 0.1")
def semantic_boundaries(spark, sf):
    """Where neighbouring chunks of a document are unlike, and at which character."""
    return vector.boundaries(vectors(spark, sf), "label", "doc_id", F.col("doc_id") % 50, 0.1)


# --- ranking ---


@query("SELECT doc_id, round(0.3::DOUBLE * exp(-0.693::DOUBLE * greatest(60 * 86400 - doc_id * 3600, 0) / 604800) / 61, 9) AS boost FROM documents")
def recency_boost(spark, sf):
    return corpus(spark, sf).select("doc_id", F.round(ranking.recency(F.col("age")), 9).alias("boost"))


@query(f"WITH {D} SELECT doc_id, round(CASE WHEN contains(lower(path), 'src1') OR contains(lower(path), 'de/') THEN 1.0 / 61 ELSE 0 END::DOUBLE, 9) AS boost FROM d")
def path_boost(spark, sf):
    return corpus(spark, sf).select("doc_id", F.round(ranking.path_boost(F.col("path"), ["src1", "de/"]), 9).alias("boost"))


@query(f"WITH {V}, {_Q}, s AS (SELECT doc_id, label, round(list_inner_product(v, q), 6) AS score FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) AS nth FROM s) SELECT doc_id, label, score FROM r ORDER BY (nth > 1), score DESC, doc_id LIMIT 15")
def diverse_topk(spark, sf):
    """The best of each label first."""
    s = vectors(spark, sf).crossJoin(F.broadcast(_query_vector(spark, sf))).select("doc_id", "label", vector.rounded(vector.dot(F.col("v"), F.col("q")), 6).alias("score"))
    return ranking.diverse(s, "label", "score", "doc_id", 15).select("doc_id", "label", "score")


@query("WITH s AS (SELECT event_type || '/' || user_id AS path, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 2) SELECT path, round(n / max(n) OVER (), 6) AS boost FROM s")
def feedback_boosts(spark, sf):
    """Paths that were selected twice or more, against the most selected one."""
    s = table(spark, sf, "events").where("event_type = 'click'").groupBy(F.concat_ws("/", "event_type", "user_id").alias("path")).agg(F.count("*").alias("n")).where("n >= 2")
    return s.crossJoin(F.broadcast(s.agg(F.max("n").alias("most")))).select("path", F.round(F.col("n") / F.col("most"), 6).alias("boost"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS selected FROM events")
def feedback_stats(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("selected"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def ring_buffer(spark, sf):
    """The last five events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id", "event_type")


# --- events ---


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_event_per_key(spark, sf):
    return live.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, arg_max(event_type, (ts, event_id)) AS op, count(*) AS n FROM s GROUP BY user_id, s")
def debounce_events(spark, sf):
    """Each run of a user's events within an hour, with its last operation."""
    return live.debounce(table(spark, sf, "events"), "user_id", "ts", "event_type", "1 hour", tie="event_id")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
def debounce_sessions(spark, sf):
    """Events of a user that follow within an hour are one."""
    s = live.debounce(table(spark, sf, "events"), "user_id", "ts", "event_type", "1 hour")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT user_id, count(*) AS attempts, CASE WHEN count(*) <= 3 THEN 2 * count(*) END AS delay_s, CASE WHEN count(*) <= 3 THEN 'retry' ELSE 'quarantine' END AS state FROM events WHERE value < 10 GROUP BY user_id")
def retry_quarantine(spark, sf):
    return live.retry_state(table(spark, sf, "events").where("value < 10"), "user_id")
